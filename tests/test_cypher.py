"""Cypher on a small graph held in memory: what no table of the others shows, and what is refused."""

import pytest

from graphloam.cypher.errors import BindError, CypherError, CypherTypeError, ParseError, Unsupported
from graphloam.cypher.graph import Graph, NodeTable, RelTable
from graphloam.cypher.session import GraphSession


@pytest.fixture(scope="module")
def session(spark):
    """1 -> 2 -> 3 -> 1 and 3 -> 4 over X, 2 -> 4 over Y, and a loop at 4."""
    nodes = spark.createDataFrame([(i, f"n{i}", ["Odd"] if i % 2 else []) for i in range(1, 5)], "_k bigint, name string, _labels array<string>")
    x = spark.createDataFrame([(1, 2, 12, 1), (2, 3, 23, 2), (3, 1, 31, 3), (3, 4, 34, 4)], "_src bigint, _dst bigint, _id bigint, w bigint")
    y = spark.createDataFrame([(2, 4, 24, 5), (4, 4, 44, 6)], "_src bigint, _dst bigint, _id bigint, w bigint")
    return GraphSession(Graph(spark, {"N": NodeTable("N", nodes)}, [RelTable("X", "N", "N", x), RelTable("Y", "N", "N", y)]))


def rows(session, text, **params):
    return sorted((tuple(r) for r in session.run(text, params).collect()), key=str)


def test_unlimited_walks(session):
    assert rows(session, "MATCH (a {name: 'n1'})-[r:X*]->(b) RETURN b.name, size(r)") == [("n1", 3), ("n2", 1), ("n3", 2), ("n4", 3)]
    assert rows(session, "MATCH (a {name: 'n1'})-[:X*]->(b) RETURN DISTINCT b.name") == [("n1",), ("n2",), ("n3",), ("n4",)]
    assert rows(session, "MATCH (a {name: 'n1'})-[:X*0..9]->(b) RETURN count(DISTINCT b) AS n") == [(4,)]
    assert rows(session, "MATCH (a)-[:X*1..2]->(b {name: 'n4'}) RETURN DISTINCT a.name") == [("n2",), ("n3",)]
    assert rows(session, "MATCH (a {name: 'n4'})-[r*2]-(b) RETURN b.name, [x IN r | x.w]") == [("n1", [4, 3]), ("n1", [5, 1]), ("n2", [4, 2]), ("n2", [6, 5]), ("n3", [5, 2]), ("n3", [6, 4])]


def test_walk_in_both_directions_repeats_no_relationship(session):
    got = rows(session, "MATCH (a {name: 'n4'})-[r:Y*1..3]-(b) RETURN b.name, [x IN r | x.w]")
    assert got == [("n2", [5]), ("n2", [6, 5]), ("n4", [6])]


def test_pinned_walk(session):
    text = "MATCH (a {name: 'n1'})-[r:X*2]->(b) WITH a, r MATCH (a)-[r:X*]->(c) RETURN c.name, size(r)"
    assert rows(session, text) == [("n3", 2)]
    assert rows(session, "MATCH (a {name: 'n1'})-[r:X*2]->(b) WITH a, r MATCH (a)<-[r:X*]-(c) RETURN c.name") == []


def test_whole_paths(session):
    got = rows(session, "MATCH p = (a {name: 'n1'})-[:X]->()-[:X]->(b) RETURN [n IN nodes(p) | n.name], [r IN relationships(p) | r.w], length(p)")
    assert got == [(["n1", "n2", "n3"], [1, 2], 2)]


def test_sets_of_rows_keep_their_counts(session):
    assert rows(session, "MATCH (a)-->(b) MATCH (b)-->(c) RETURN count(*) AS n") == [(8,)]
    assert rows(session, "MATCH (a)-->(b) MATCH (b)-->(c) RETURN count(DISTINCT c) AS n") == [(4,)]
    assert rows(session, "MATCH (a)-->(b) MATCH (b)-->(c) WITH DISTINCT c RETURN count(*) AS n") == [(4,)]
    assert rows(session, "MATCH (a)-->(b) MATCH (b)-->(c) RETURN min(c.name), max(b.name)") == [("n1", "n4")]


@pytest.mark.parametrize(
    "text, error",
    [
        ("MATCH (n) RETURN n.name =~ 'a.*'", Unsupported),
        ("RETURN 1 UNION RETURN 2", ParseError),
        ("FOREACH (x IN [1] | SET x.y = 1)", ParseError),
        ("LOAD CSV FROM 'x' AS r RETURN r", ParseError),
        ("CALL { RETURN 1 } RETURN 1", ParseError),
        ("MATCH (n) WHERE EXISTS { (n)-->() } RETURN n", ParseError),
        ("MATCH p = shortestPath((a)-[*]-(b)) RETURN p", CypherError),
        ("MATCH (n) RETURN n {.name}", ParseError),
        ("RETURN date()", BindError),
        ("RETURN nosuch(1)", BindError),
        ("MATCH (n) RETURN count(sum(n.name))", BindError),
        ("MATCH (n) WHERE count(n) > 1 RETURN n", BindError),
        ("MATCH (n:Nope) RETURN n", CypherError),
        ("MATCH ()-[:Z]->() RETURN 1", BindError),
        ("MATCH (n) RETURN m", BindError),
        ("MATCH (n) RETURN n.name AS a, 1 AS a", BindError),
        ("MATCH (n) WITH n.name RETURN 1", ParseError),
        ("RETURN $missing", BindError),
        ("RETURN 1 LIMIT -1", CypherTypeError),
        ("RETURN NOT 1", CypherTypeError),
        ("UNWIND 5 AS x RETURN x", CypherTypeError),
        ("CALL nothing()", BindError),
        ("MATCH (n) SET n.x = 1", Unsupported),
        ("RETURN " + "(" * 3000 + "1" + ")" * 3000, CypherError),
    ],
)
def test_refused(session, text, error):
    if text.startswith("MATCH (n:Nope)"):
        assert session.run(text).collect() == []  # a secondary label can be any name
        return
    with pytest.raises(error):
        session.run(text).collect()
