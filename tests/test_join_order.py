"""The hops of one MATCH are joined in an order that keeps rows within the largest table."""

import pytest

from graphloam.cypher.compiler import Pattern
from graphloam.cypher.errors import BindError
from graphloam.cypher.graph import Graph, NodeTable, RelTable
from graphloam.cypher.session import GraphSession

CUSTOMERS, SUPPLIERS, ORDERS = 12, 10, 30
LINES = [(o, (o * 7 + k) % SUPPLIERS, o * 10 + k) for o in range(ORDERS) for k in range(3)]
NATION = lambda key: key % 2


def values(spark, rows: list[tuple], columns: str):
    """Rows within the plan, without a Python worker."""
    kinds = [col.split() for col in columns.split(", ")]
    return spark.sql(f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in kinds)} FROM VALUES {', '.join(map(str, rows))} AS v({', '.join(n for n, _ in kinds)})")


def graph(spark, known: bool) -> Graph:
    """Customers and suppliers of two nations; *known*: which ends occur once."""
    nodes = {label: NodeTable(label, values(spark, [(i, f"{label}{i}") for i in range(n)], "_k bigint, name string"), ("name",)) for label, n in (("C", CUSTOMERS), ("S", SUPPLIERS), ("O", ORDERS), ("N", 2))}
    tables = [
        ("LIVES_IN", "C", "N", [(i, NATION(i), i) for i in range(CUSTOMERS)], ("src",)),
        ("BASED_IN", "S", "N", [(i, NATION(i), i) for i in range(SUPPLIERS)], ("src",)),
        ("PLACED", "C", "O", [(o % CUSTOMERS, o, o) for o in range(ORDERS)], ("dst",)),
        ("SHIPPED_BY", "O", "S", LINES, ()),
    ]
    return Graph(spark, nodes, [RelTable(t, a, b, values(spark, rows, "_src bigint, _dst bigint, _id bigint"), once=once if known else ()) for t, a, b, rows, once in tables])


EXPECTED = sorted((f"N{NATION(s)}", f"C{o % CUSTOMERS}", f"O{o}", f"S{s}") for o, s, _ in LINES if NATION(s) == NATION(o % CUSTOMERS))
FORMS = [
    "MATCH (c:C)-[:LIVES_IN]->(n:N)<-[:BASED_IN]-(s:S), (c)-[:PLACED]->(o)-[:SHIPPED_BY]->(s)",
    "MATCH (s)-[:BASED_IN]->(n)<-[:LIVES_IN]-(c)-[:PLACED]->(o)-[:SHIPPED_BY]->(s)",
    "MATCH (n:N)<-[:BASED_IN]-(s), (n)<-[:LIVES_IN]-(c), (o)<-[:PLACED]-(c), (s)<-[:SHIPPED_BY]-(o)",
    "MATCH (o:O), (c)-[:LIVES_IN]->(n)<-[:BASED_IN]-(s:S), (c)-[:PLACED]->(o)-[:SHIPPED_BY]->(s)",
]


@pytest.fixture
def sizes(monkeypatch):
    """The rows of the frame after each hop."""
    out, hop = [], Pattern._hop

    def counted(self, *args):
        binding = hop(self, *args)
        out.append(self.df.count())
        return binding

    monkeypatch.setattr(Pattern, "_hop", counted)
    return out


@pytest.mark.parametrize("text", FORMS[:3])
def test_no_hop_leaves_more_rows_than_the_largest_table(spark, sizes, text):
    got = GraphSession(graph(spark, True)).run(text + " RETURN n.name, c.name, o.name, s.name").collect()
    assert sorted(map(tuple, got)) == EXPECTED
    assert len(sizes) == 4 and max(sizes) <= len(LINES)


@pytest.mark.parametrize("text, known", [*[(text, True) for text in FORMS], (FORMS[0], False)])
def test_results_do_not_depend_on_the_order(spark, text, known):
    session = GraphSession(graph(spark, known))
    assert sorted(map(tuple, session.run(text + " RETURN n.name, c.name, o.name, s.name").collect())) == EXPECTED
    some = [x for x in EXPECTED if x[1] == "C3"]
    assert sorted(map(tuple, session.run("MATCH (c:C {name: 'C3'}) " + text + " RETURN n.name, c.name, o.name, s.name").collect())) == some
    assert session.run("MATCH (x:C) OPTIONAL " + text + " WHERE x.name = c.name AND c.name = 'C3' RETURN s.name").count() == CUSTOMERS - 1 + len(some)


def test_variables_and_paths_stay_as_written(spark):
    text = "MATCH p = (c:C {name: 'C3'})-[:LIVES_IN]->(n)<-[b:BASED_IN]-(s), q = (c)-[:PLACED]->(o)-[:SHIPPED_BY]->(s) RETURN "
    known, unknown = (GraphSession(graph(spark, x)) for x in (True, False))
    assert known.run(text + "*").columns == unknown.run(text + "*").columns
    names = "[x IN nodes(p) | x.name] AS p, [x IN nodes(q) | x.name] AS q, length(q) AS n"
    got = sorted((r["p"], r["q"], r["n"]) for r in known.run(text + names).collect())
    assert got == sorted((["C3", n, s], ["C3", o, s], 2) for n, c, o, s in EXPECTED if c == "C3")


def test_maps_that_read_the_pattern_and_misuse_of_names(spark, sizes):
    session = GraphSession(graph(spark, True))
    text = "MATCH (c:C)-[:LIVES_IN]->(n:N)<-[:BASED_IN]-(s:S), (c)-[:PLACED]->(o {name: 'O' + size(c.name)})-[:SHIPPED_BY]->(s) RETURN o.name, c.name"
    want = sorted((o, c) for _, c, o, _ in EXPECTED if o == f"O{len(c)}")
    assert sorted(map(tuple, session.run(text).collect())) == want
    for broken in ("MATCH (c)-[r:LIVES_IN]->(n)<-[:BASED_IN]-(s), (c)-[:PLACED]->(r)-[:SHIPPED_BY]->(s) RETURN 1", "MATCH (c)-[r:LIVES_IN]->(n)<-[r:BASED_IN]-(s), (c)-[:PLACED]->(o)-[:SHIPPED_BY]->(s) RETURN 1"):
        with pytest.raises(BindError):
            session.run(broken)
