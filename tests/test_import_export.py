import json

import pytest

from graphloam.cypher.errors import BindError, CypherError
from graphloam.sinks import exports
from graphloam.sources.imports import EdgeMapping, ImportFailed, NodeMapping, import_df, import_file
from graphloam.version.repo import GraphRepo
from graphloam.version.session import RepoSession


@pytest.fixture
def repo(spark, tmp_path):
    r = GraphRepo(spark, f"file://{tmp_path}/repo")
    r.apply_schema({"labels": {"Host": {"key": ["name"], "types": {"port": "int", "up": "bool", "load": "float", "since": "date"}}, "Pair": {"key": ["a", "b"]}}, "relationship_types": {"LINK": {"discriminator": "slot", "types": {"w": "int"}}}})
    return r


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path}/{name}"


def test_files_become_nodes_and_edges(repo, tmp_path, spark):
    csv = put(tmp_path, "hosts.csv", 'name,port,up,load,since,note\na,80,true,1.5,2024-01-02,"x, ""y""\nz"\nb,,,,,\nb,,,,,\n')
    first = import_file(repo, csv, NodeMapping("Host"))
    trailers = repo.read_commit(first)["trailers"]
    assert trailers["Extractor"] == "csv" and len(trailers["Source-SHA256"]) == 64
    assert import_file(repo, csv, NodeMapping("Host")) is None
    s = RepoSession(repo)
    assert sorted(tuple(r) for r in s.run("MATCH (h:Host) RETURN h.name, h.port, h.up, h.load, h.note").collect()) == [("a", 80, True, 1.5, 'x, "y"\nz'), ("b", None, None, None, None)]
    import_file(repo, put(tmp_path, "p.json", json.dumps([{"a": "1", "b": "2", "tags": ["x"]}, {"a": "1", "b": "3"}])), NodeMapping("Pair"))
    import_file(repo, put(tmp_path, "e.ndjson", '{"h": "a", "x": "1", "y": "2", "slot": "s1", "w": 4}\n{"h": "a", "x": "1", "y": "2", "slot": "s2", "w": null}\n'), EdgeMapping("LINK", "Host=h", "Pair=x,y", "slot"))
    got = s.run("MATCH (h:Host)-[l:LINK]->(p:Pair) RETURN h.name, l.slot, l.w, p.b").collect()
    assert sorted(tuple(r) for r in got) == [("a", "s1", 4, "2"), ("a", "s2", None, "2")]
    head = repo.head
    for mapping, text in (
        (NodeMapping("Host"), '[{"name": "c", "in": {"x": 1}}]'),
        (NodeMapping("Host"), '[{"name": "c", "in": [[1]]}]'),
        (NodeMapping("Host"), '[{"name": "c", "port": "8o"}]'),
        (NodeMapping("Host"), '[{"name": "c", "port": 1}, {"name": "c", "port": 2}]'),
        (NodeMapping("Host"), '[{"port": 1}]'),
        (NodeMapping("Hosts"), '[{"name": "c"}]'),
        (EdgeMapping("LINK", "Host=h", "Host=k"), '[{"h": "a", "k": "none"}]'),
        (EdgeMapping("LINK", "Host=h", "Pair=k"), '[{"h": "a", "k": "b"}]'),
        (EdgeMapping("NONE", "Host=h", "Host=k"), '[{"h": "a", "k": "b"}]'),
    ):
        with pytest.raises(CypherError):
            import_file(repo, put(tmp_path, "bad.json", text), mapping)
    assert repo.head == head and not repo._dirty()
    with pytest.raises(ImportFailed):
        import_df(repo, spark.createDataFrame([("d", "maybe")], "name string, up string"), NodeMapping("Host"))
    assert import_df(repo, spark.createDataFrame([("d", "true")], "name string, up string"), NodeMapping("Host"))


def test_exports_and_reports(repo, tmp_path, spark):
    import_df(repo, spark.createDataFrame([("a", 1, float("nan"), ["x", "y"]), ("b", None, None, None)], "name string, port int, load double, tags array<string>"), NodeMapping("Host"))
    import_df(repo, spark.createDataFrame([("a", "b", "s", 3)], "h string, k string, slot string, w int"), EdgeMapping("LINK", "Host=h", "Host=k", "slot"))
    g = repo.graph()
    nodes = exports.export_nodes(g, "Host")
    assert nodes.columns == ["name", "load", "port", "tags"]
    edges = exports.export_edges(g, "LINK")
    assert edges.columns == ["src", "dst", "slot", "w"] and [tuple(r) for r in edges.collect()] == [("a", "b", "s", 3)]
    out = f"file://{tmp_path}/out"
    exports.write(nodes, out + "/csv", "csv")
    assert sorted(tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(out + "/csv").collect()) == [("a", "NaN", "1", '["x","y"]'), ("b", None, None, None)]
    exports.write(nodes, out + "/json", "ndjson")
    assert sorted(r[0] for r in spark.read.text(out + "/json").collect()) == ['{"name":"a","port":1,"tags":["x","y"]}', '{"name":"b"}']
    exports.write(nodes, out + "/parquet", "parquet")
    assert spark.read.parquet(out + "/parquet").count() == 2
    assert list(exports.render(edges, "csv")) == ["src,dst,slot,w", "a,b,s,3"] and list(exports.render(edges, "table"))[1] == "a | b | s | 3"
    assert list(exports.render(edges, "json")) == ['{"src":"a","dst":"b","slot":"s","w":3}']
    import_df(repo, spark.createDataFrame([("a", "b")], "a string, b string"), NodeMapping("Pair"))
    import_df(repo, spark.createDataFrame([("a", "a", "b", "s")], "h string, x string, y string, slot string"), EdgeMapping("LINK", "Host=h", "Pair=x,y", "slot"))
    with pytest.raises(CypherError):
        exports.export_edges(repo.graph(), "LINK")
    for bad in (lambda: exports.export_nodes(g, "Hots"), lambda: exports.export_edges(g, "X"), lambda: exports.write(nodes, out + "/x", "xml"), lambda: list(exports.render(nodes, "xml"))):
        with pytest.raises(BindError):
            bad()
    lines = [r["line"] for r in exports.report_lines(repo.diff("HEAD~2", "HEAD~1"), repo.conflicts()).collect()]
    assert lines[0].startswith("| kind") and lines[2] == "| node | Pair | \\[\"a\",\"b\"\\] | added | a |  | a |".replace("\\[", "[").replace("\\]", "]")
    one = [json.loads(r["line"]) for r in exports.report_lines(repo.diff("HEAD~2", "HEAD~1"), format="json").collect()]
    assert {(x["label"], x["property"], x["after"]) for x in one} == {("Pair", "a", "a"), ("Pair", "b", "b")}
