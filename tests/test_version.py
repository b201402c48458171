import pytest

from graphloam.cypher.errors import BindError, CypherError, WriteError
from graphloam.version.repo import GraphRepo
from graphloam.version.schema import ConstraintError
from graphloam.version.session import RepoSession


@pytest.fixture
def repo(spark, tmp_path):
    r = GraphRepo(spark, f"file://{tmp_path}/repo")
    r.apply_schema({"labels": {"Host": {"key": ["id"], "types": {"id": "int", "name": "string", "size": "float"}}, "Pkg": {"key": ["name", "version"]}}, "relationship_types": {"RUNS": {"discriminator": "port"}, "NEEDS": {}}})
    return r


def rows(session, text, **params):
    return sorted(tuple(r) for r in session.run(text, params).collect())


def test_create_read_and_refusals(repo):
    s = RepoSession(repo)
    s.run("UNWIND [1, 2, 3] AS i CREATE (h:Host:Web {id: i, name: 'h' + i})")
    assert (s.summary.nodes_created, s.summary.properties_set, s.summary.labels_added) == (3, 6, 6)
    assert rows(s, "MATCH (h:Web) WHERE h.id > 1 RETURN h.id, h.name, labels(h)") == [(2, "h2", ["Host", "Web"]), (3, "h3", ["Host", "Web"])]
    s.run("CREATE (p:Pkg {name: 'a', version: '1'}), (q:Pkg {name: 'b', version: '1'}), (p)-[:NEEDS {w: 5}]->(q)")
    assert rows(s, "MATCH (p:Pkg)-[r:NEEDS]->(q) RETURN p.name, q.name, r.w") == [("a", "b", 5)]
    got = s.run("MATCH (h:Host {id: 1}), (p:Pkg {name: 'a'}) CREATE (h)-[r:RUNS {port: 80}]->(p) RETURN type(r) AS t, r.port AS port").collect()
    assert [tuple(r) for r in got] == [("RUNS", 80)]
    s.run("MATCH (h:Host {id: 1}), (p:Pkg {name: 'a'}) CREATE (h)-[:RUNS {port: 81}]->(p)")
    assert rows(s, "MATCH (:Host)-[r:RUNS]->(:Pkg) RETURN r.port") == [(80,), (81,)]
    before = repo.workspace.hash
    for bad in (
        "CREATE (:Host {id: 1})",  # there already
        "UNWIND [7, 7] AS i CREATE (:Host {id: i})",
        "CREATE (:Host {name: 'x'})",
        "CREATE (:Nope {id: 1})",
        "CREATE (:Host:Pkg {id: 9, name: 'a', version: 'z'})",
        "MATCH (h:Host {id: 1}), (p:Pkg {name: 'a'}) CREATE (h)-[:RUNS {port: 80}]->(p)",
        "MATCH (h:Host {id: 1}) SET h.id = 5",
        "MATCH (h:Host {id: 1}) CREATE (h:Web)",
        "MATCH (a:Host), (b:Host) CREATE (a)-[:RUNS|NEEDS]->(b)",
        "MATCH (a:Host {id: 1}) DELETE a",
        "CREATE (:Host {id: 8, name: 5})",
        "MATCH (a:Host {id: 1}), (b:Host {id: 2}) CREATE (a)-[:COINED]->(b)",
    ):
        with pytest.raises(CypherError):
            s.run(bad)
        assert repo.workspace.hash == before, bad
    coin = RepoSession(repo, autodeclare=True)
    coin.run("MATCH (a:Host {id: 1}), (b:Host {id: 2}) CREATE (a)-[:COINED]->(b)")
    assert rows(s, "MATCH (a)-[:COINED]->(b) RETURN a.id, b.id") == [(1, 2)]


def test_set_remove_delete(repo):
    s = RepoSession(repo)
    s.run("UNWIND [1, 2, 3] AS i CREATE (:Host {id: i, name: 'h', size: i})")
    out = s.run("MATCH (h:Host) WHERE h.id < 3 SET h.size = h.size * 10, h.tag = 'x' RETURN h.id AS i, h.size AS s, h.tag AS t ORDER BY i").collect()
    assert [tuple(r) for r in out] == [(1, 10.0, "x"), (2, 20.0, "x")]
    s.run("MATCH (h:Host {id: 1}) SET h.size = null, h:Web:Edge")
    s.run("MATCH (h:Host {id: 2}) SET h += {tag: null, extra: 4}")
    s.run("MATCH (h:Host {id: 3}) SET h = {id: 3, only: true}")
    want = [(1, "h", None, "x", None, None, ["Host", "Web", "Edge"]), (2, "h", 20.0, None, 4, None, ["Host"]), (3, None, None, None, None, True, ["Host"])]
    got = rows(s, "MATCH (h:Host) RETURN h.id, h.name, h.size, h.tag, h.extra, h.only, labels(h)")
    assert [(*r[:-1], sorted(r[-1])) for r in got] == [(*w[:-1], sorted(w[-1])) for w in want]
    s.run("MATCH (h:Host {id: 1}) REMOVE h.tag, h:Web")
    assert s.summary.labels_removed == 1
    assert rows(s, "MATCH (h:Host {id: 1}) RETURN h.tag, labels(h)") == [(None, ["Host", "Edge"])]
    s.run("OPTIONAL MATCH (h:Host {id: 99}) SET h.name = 'no'")
    s.run("UNWIND [1, 2, 3] AS v MATCH (h:Host {id: 2}) SET h.last = v")
    assert rows(s, "MATCH (h:Host {id: 2}) RETURN h.last") == [(3,)]
    s.run("MATCH (a:Host {id: 1}), (b:Host {id: 2}) CREATE (a)-[:NEEDS]->(b)-[:NEEDS]->(b)")
    s.run("MATCH (:Host {id: 1})-[r:NEEDS]->() DELETE r")
    assert s.summary.relationships_deleted == 1
    s.run("MATCH (h:Host {id: 2}) DETACH DELETE h")
    assert (s.summary.nodes_deleted, s.summary.relationships_deleted) == (1, 1)
    assert rows(s, "MATCH (h:Host) RETURN h.id") == [(1,), (3,)]
    assert rows(s, "MATCH ()-[r]->() RETURN count(r) AS n") == [(0,)]


def test_merge_clause(repo):
    s = RepoSession(repo)
    s.run("CREATE (:Host {id: 1, name: 'old'})")
    s.run("UNWIND [1, 2, 2, 3] AS i MERGE (h:Host {id: i}) ON CREATE SET h.name = 'new' ON MATCH SET h.seen = true")
    assert rows(s, "MATCH (h:Host) RETURN h.id, h.name, h.seen") == [(1, "old", True), (2, "new", True), (3, "new", None)]
    s.run("MATCH (a:Host {id: 1}), (b:Host) WHERE b.id > 1 MERGE (a)-[r:NEEDS]->(b) ON CREATE SET r.w = b.id")
    s.run("MATCH (a:Host {id: 1}), (b:Host) MERGE (a)-[r:NEEDS]->(b)")
    assert rows(s, "MATCH (:Host)-[r:NEEDS]->(b) RETURN b.id, r.w") == [(1, None), (2, 2), (3, 3)]
    with pytest.raises(WriteError):
        s.run("MERGE (h:Host {id: 5, name: null})")


def test_commits_refs_and_time_travel(repo):
    s = RepoSession(repo)
    s.run("CREATE (:Host {id: 1, name: 'a'})")
    one = repo.commit("first\n\nbody", trailers={"Source": "x"})
    with pytest.raises(CypherError):
        repo.commit("again")
    repo.tag("v1")
    s.run("MATCH (h:Host) SET h.name = 'b'")
    with pytest.raises(CypherError):
        repo.checkout("v1")
    s.run("CREATE (:Host {id: 7})")
    two = repo.commit("second")
    three = repo.commit("empty", allow_empty=True)
    assert [c["commit"] for c in repo.log()] == [three, two, one] and repo.read_commit(one)["trailers"] == {"Source": "x"}
    assert [repo.resolve(x) for x in ("HEAD", "main~1", "HEAD^^", "v1", "refs/heads/main", "refs/tags/v1", one[:12])] == [three, two, one, one, three, one, one]
    for bad in ("nope", "v1~1", "HEAD^2"):
        with pytest.raises(BindError):
            repo.resolve(bad)
    assert rows(s, "MATCH (o:Host) AT 'v1' MATCH (n:Host) WHERE n.id = o.id RETURN o.name, n.name") == [("a", "b")]
    assert rows(RepoSession(repo, at="v1"), "MATCH (h:Host) RETURN h.name") == [("a",)]
    with pytest.raises(WriteError):
        RepoSession(repo, at="v1").run("CREATE (:Host {id: 9})")
    assert rows(s, "CALL log() YIELD subject RETURN subject") == [("empty",), ("first",), ("second",)]
    assert rows(s, "CALL blame('Host', '1') YIELD commit, subject RETURN commit, subject") == sorted([(two, "second"), (one, "first")])
    assert [b["commit"] for b in repo.blame("Host", "1")] == [two, one]
    got = rows(s, "CALL diff('v1', 'main') YIELD kind, label, key, node RETURN kind, label, key, node")
    assert [g[:3] for g in got] == [("added", "Host", "7"), ("modified", "Host", "1")] and '"_Modified","Host"' in got[1][3]
    d = {r["key"]: r for r in repo.diff("v1", "main").collect()}
    assert (d["1"]["before"], d["1"]["after"], d["1"]["properties"]) == ({"name": "a"}, {"name": "b"}, ["name"])
    assert rows(s, "CALL conflicts()") == []


def test_same_contents_same_hash(spark, tmp_path):
    hashes = set()
    for n, order in enumerate((["1, 2, 3"], ["3", "1", "2"], ["2, 9", "1, 3"])):
        r = GraphRepo(spark, f"file://{tmp_path}/r{n}", rows_per_bucket=[None, 1, 2][n])
        r.declare_label("Host", ["id"])
        s = RepoSession(r)
        for part in order:
            s.run(f"UNWIND [{part}] AS i CREATE (:Host {{id: i, v: i * 2}})")
        s.run("MATCH (h:Host {id: 9}) DELETE h")
        hashes.add(r.workspace.hash)
    assert len(hashes) == 1


def test_merge_of_branches(repo):
    s = RepoSession(repo)
    s.run("UNWIND [1, 2, 3, 4, 5] AS i CREATE (:Host {id: i, name: 'n', size: 1, note: 'b'})")
    repo.commit("base")
    repo.branch("other")
    assert repo.merge("other") == "up to date"
    s.run("MATCH (h:Host {id: 1}) SET h.name = 'ours'")
    s.run("MATCH (h:Host {id: 2}) SET h.name = 'ours', h:Left")
    s.run("MATCH (h:Host {id: 3}) DELETE h")
    s.run("MATCH (h:Host {id: 4}) DELETE h")
    s.run("CREATE (:Host {id: 8, name: 'both', size: 1})")
    ours = repo.commit("ours")
    repo.checkout("other")
    s.run("MATCH (h:Host {id: 1}) SET h.note = 'theirs'")
    s.run("MATCH (h:Host {id: 2}) SET h.name = 'theirs', h:Right")
    s.run("MATCH (h:Host {id: 3}) SET h.note = 'kept?'")
    s.run("CREATE (:Host {id: 8, name: 'both', size: 2})")
    theirs = repo.commit("theirs")
    repo.checkout("main")
    assert repo.merge_base("main", "other") == repo.resolve("main~1")
    assert repo.merge("other") == "conflicts"
    got = sorted(((r["key"], r["property"], r["base"], r["ours"], r["theirs"]) for r in repo.conflicts().collect()), key=str)
    assert [g[:2] for g in got] == [("2", "name"), ("3", None), ("8", "size")]
    assert ("2", "name", "n", "ours", "theirs") in got and ("8", "size", None, "1.0", "2.0") in got
    whole = next(g for g in got if g[1] is None)
    assert whole[0] == "3" and whole[3] is None and '"note":"kept?"' in whole[4]
    with pytest.raises(CypherError):
        repo.commit("too early")
    assert rows(s, "MATCH (h:Host) WHERE h.id < 3 RETURN h.id, h.name, h.note, labels(h)") == [(1, "ours", "theirs", ["Host"]), (2, None, "b", ["Host", "Left", "Right"])]
    repo.abort()
    assert repo.merge("other") == "conflicts"
    repo.resolve_all("theirs")
    assert rows(s, "MATCH (h:Host) RETURN h.id, h.name, h.note, h.size") == [(1, "ours", "theirs", 1.0), (2, "theirs", "b", 1.0), (3, "n", "kept?", 1.0), (5, "n", "b", 1.0), (8, "both", None, 2.0)]
    done = repo.commit("merged")
    assert repo.read_commit(done)["parents"] == [ours, theirs]
    repo.checkout("other")
    assert repo.merge("main") == "fast forward" and repo.resolve("other") == done
    assert {c["message"] for c in repo.log(every=True)} == {"base", "ours", "theirs", "merged"} and repo.log(every=True)[0]["commit"] == done


def test_merge_that_breaks_references(repo):
    s = RepoSession(repo)
    s.run("UNWIND [1, 2] AS i CREATE (:Host {id: i})")
    repo.commit("base")
    repo.branch("other")
    s.run("MATCH (h:Host {id: 2}) DELETE h")
    repo.commit("ours")
    repo.checkout("other")
    s.run("MATCH (a:Host {id: 1}), (b:Host {id: 2}) CREATE (a)-[:NEEDS]->(b)")
    repo.commit("theirs")
    repo.checkout("main")
    assert repo.merge("other") == "conflicts"
    assert ["does not exist" in r["ours"] for r in repo.conflicts().collect()] == [True]
    with pytest.raises(ConstraintError):
        repo.commit("no")
    s.run("MATCH ()-[r:NEEDS]->() DELETE r")
    repo.commit("yes")


def test_schema_rules_and_maintenance(repo, spark):
    s = RepoSession(repo)
    s.run("UNWIND [1, 2] AS i CREATE (:Host {id: i, name: 'same', note: 'n' + i})")
    for bad in ({"key": ["name"]}, {"key": ["id"], "types": {"note": "int"}}, {"key": ["id"], "required": ["size"]}, {"key": ["id"], "unique": ["name"]}):
        with pytest.raises(CypherError):
            repo.declare_label("Host", **bad)
    repo.declare_label("Host", ["id"], required=["name"], unique=["note"])
    for bad in ("CREATE (:Host {id: 3})", "CREATE (:Host {id: 3, name: 'x', note: 'n1'})", "MATCH (h:Host {id: 1}) REMOVE h.name"):
        with pytest.raises(CypherError):
            s.run(bad)
    repo.declare_label("Auto", surrogate=True)
    s.run("UNWIND [1, 1] AS i CREATE (:Auto {v: i})")
    assert rows(s, "MATCH (a:Auto) RETURN count(DISTINCT a._id) AS n") == [(2,)]
    s.run("MATCH (a:Host {id: 1}), (b:Host {id: 2}) CREATE (a)-[:NEEDS]->(b), (a)-[:RUNS {port: 1}]->(b)")
    with pytest.raises(CypherError):
        repo.declare_relationship("RUNS", discriminator="other")
    from pyspark.sql import functions as F

    repo.rekey("Host", spark.createDataFrame([("1",)], "_k string"), {"id": F.col("id") + 100})
    assert rows(s, "MATCH (a:Host)-[:NEEDS]->(b) RETURN a.id, b.id") == [(101, 2)]
    with pytest.raises(BindError):
        repo.rename_relationship("NOPE", "X")
    repo.rename_relationship("NEEDS", "REQUIRES")
    assert rows(s, "MATCH (a)-[r:REQUIRES]->(b) RETURN a.id, type(r)") == [(101, "REQUIRES")]
    repo.commit("state")
    assert repo.fsck() == [] and repo.fsck("HEAD") == []
    assert repo.gc() > 0 and repo.fsck("HEAD") == []
    new = repo.migrate(lambda m: m)
    assert repo.resolve("HEAD") in new.values()
    t = repo.workspace.nodes["Host"]
    repo.files.delete(t.buckets[0][1][0])
    assert "missing" in repo.fsck()[0]
