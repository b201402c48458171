import random
from datetime import datetime

from graphloam.operators.snapshots import snapshot_changes

DDL = "no int, host string, a string, n bigint, tags array<string>, d timestamp, at string, state int"
T0 = datetime(2024, 1, 1)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(no, k, a, n, tags, T0.replace(hour=i % 24), "clash", 0) for i, (no, k, a, n, tags) in enumerate(rows)], DDL)
    out = snapshot_changes(df, "host", "no", ["a", "n", "tags"], sets=("tags",), delivered="d", **kw)
    return sorted(((r["no"], r["host"], r["change"]), r["before"], r["after"], r["changed"]) for r in out.collect())


def test_kinds(spark):
    rows = [(1, "x", "p", 1, ["u", "v"]), (1, "y", None, 1, None), (1, "z", "p", 1, []), (4, "x", "p", 1, ["v", "u", "v"]), (4, "y", "", 1, None), (4, "w", "p", 1, None), (9, "x", "p", 2, ["u", "v"]), (9, "z", "p", 1, None), (9, "y", "", 1, []), (9, None, "p", 1, None), (None, "x", "p", 1, None)]
    got = run(spark, rows)
    assert [g[0] for g in got] == [(4, "w", "added"), (4, "y", "modified"), (4, "z", "removed"), (9, "w", "removed"), (9, "x", "modified"), (9, "y", "modified"), (9, "z", "added")]
    by = {g[0]: g for g in got}
    assert by[4, "y", "modified"][3] == ["a"] and by[9, "y", "modified"][3] == ["tags"] and by[9, "x", "modified"][3] == ["n"]
    assert by[4, "z", "removed"][1]["a"] == "p" and by[4, "z", "removed"][2] is None and by[4, "w", "added"][1] is None
    assert by[9, "x", "modified"][1]["n"] == 1 and by[9, "x", "modified"][2]["n"] == 2


def test_latest_delivery_holds_and_empty(spark):
    assert run(spark, [(1, "x", "p", 1, None), (2, "x", "q", 1, None), (2, "x", "p", 1, None)]) == []
    assert run(spark, []) == [] and run(spark, [(1, "x", "p", 1, None)]) == []


def test_random_against_brute_force_over_many_batches(spark):
    rng = random.Random(5)
    rows, states = [], {}
    for no in (2, 3, 5, 8):
        states[no] = {f"h{i}": rng.choice("pq") for i in range(400) if rng.random() < 0.8}
        rows += [(no, k, a, 1, None) for k, a in states[no].items() for _ in range(rng.choice([1, 1, 2]))]
    rng.shuffle(rows)
    want = []
    for a, b in ((2, 3), (3, 5), (5, 8)):
        old, new = states[a], states[b]
        want += [(b, k, "added") for k in new.keys() - old.keys()] + [(b, k, "removed") for k in old.keys() - new.keys()] + [(b, k, "modified") for k in old.keys() & new.keys() if old[k] != new[k]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = [g[0] for g in run(spark, rows, partitions=3)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(want)
