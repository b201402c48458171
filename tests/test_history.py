import random
from datetime import datetime, timedelta

import pytest

from graphloam.operators.history import as_of, attribute_log, history, unplaced
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)
COMMITS = "id string, committed_at timestamp, label string"
STATES = "commit_id string, label string, node_key string, op string, properties map<string,string>, arrived_at timestamp, bucket int, props int"
KEYS = ["label", "node_key"]


def at(i):
    return T0 + timedelta(hours=i)


def commits(spark, n):
    return spark.createDataFrame([(f"{i:040x}", at(i), "x") for i in range(n)] + [("odd id", at(n), "x")], COMMITS)


def run(spark, rows, n=20, **kw):
    states = spark.createDataFrame([(c if isinstance(c, str) else f"{c:040x}", lab, k, op, p, a, 0, 0) for c, lab, k, op, p, a in rows], STATES)
    found = history(states, commits(spark, n), KEYS, **kw)
    short = lambda x: int(x, 16) if len(x) == 40 else x
    return sorted((r["label"], r["node_key"], short(r["valid_from_id"]), short(r["valid_to_id"]), tuple(sorted(r["properties"].items()))) for r in found.collect())


def brute(rows, n):
    """Versions by walking each node's commits in order."""
    by = {}
    for c, lab, k, op, p, a in rows:
        old = by.setdefault((lab, k), {}).get(c)
        if old is None or a > old[2]:
            by[lab, k][c] = (op, tuple(sorted((x, y) for x, y in (p or {}).items() if y is not None)), a)
    out = []
    for (lab, k), timeline in by.items():
        held = None
        for c in sorted(timeline):
            op, p, _ = timeline[c]
            state = p if op == "put" else None
            if held is not None and state != held[1]:
                out.append((lab, k, held[0], c, held[1]))
            if state is not None and (held is None or state != held[1]):
                held = (c, state)
            if state is None:
                held = None
        if held is not None:
            out.append((lab, k, held[0], "", held[1]))
    return sorted(out, key=str)


def test_versions_nulls_and_late_rows(spark):
    rows = [
        (3, "L", "a", "put", {"x": "1", "y": None}, at(1)),
        (1, "L", "a", "put", {"x": "1"}, at(9)),  # late, and the same state: one version from 1
        (4, "L", "a", "put", {"x": ""}, at(4)),  # an empty text is a value
        (4, "L", "a", "put", {"x": ""}, at(5)),  # delivered again
        (5, "L", "a", "put", {}, at(5)),
        (6, "L", "a", "put", None, at(6)),
        (7, "L", "a", "delete", None, at(7)),
        (8, "L", "a", "put", None, at(8)),
    ]
    assert run(spark, rows) == [("L", "a", 1, 4, (("x", "1"),)), ("L", "a", 4, 5, (("x", ""),)), ("L", "a", 5, 7, ()), ("L", "a", 8, "", ())]


def test_odd_ids_null_keys_and_unknown_commits(spark):
    rows = [("odd id", "L", "a", "put", {"\x00": "v"}, at(1)), (1, None, "a", "put", {}, at(1)), (2, "L", "b", None, {}, at(1)), ("nowhere", "L", "c", "put", {}, at(1))]
    assert run(spark, rows) == [("L", "a", "odd id", "", (("\x00", "v"),))]
    states = spark.createDataFrame([(c if isinstance(c, str) else f"{c:040x}", lab, k, op, p, a, 0, 0) for c, lab, k, op, p, a in rows], STATES)
    assert {(r["label"], r["node_key"]) for r in unplaced(states, commits(spark, 9), KEYS).collect()} == {(None, "a"), ("L", "c")}


def test_empty(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("limit", [10**6, 12])
def test_random_against_brute_force(spark, limit):
    """Also with most rows under one key, cut into buckets of a dozen rows."""
    rng = random.Random(4)
    rows = []
    for c in range(300):
        for key in ["hot"] + rng.sample(["a", "b", "c"], rng.randint(0, 2)):
            if rng.random() < 0.85:
                p = {k: rng.choice(["1", "2", None, ""]) for k in rng.sample("xyz", rng.randint(0, 3))} if rng.random() < 0.4 else {"x": "same"}
                row = (c, "L", key, "delete" if rng.random() < 0.1 else "put", p, at(rng.randint(0, 99)))
                rows += [row] * rng.choice([1, 1, 1, 2])
    rows += [(c, "M", "long", "put", {"x": "same"}, at(0)) for c in range(0, 300, 2)]  # one version over all buckets
    rng.shuffle(rows)
    assert sorted(run(spark, rows, 300, rows_per_task=limit), key=str) == brute(rows, 300)


def test_as_of(spark):
    states = spark.createDataFrame([(f"{c:040x}", "L", "a", op, {"x": str(c)}, at(c), 0, 0) for c, op in ((1, "put"), (3, "put"), (5, "delete"))], STATES)
    found = history(states, commits(spark, 9), KEYS)
    value = lambda h: [r["properties"]["x"] for r in as_of(found, F.lit(at(h))).collect()]
    assert [value(h) for h in (0, 1, 2, 3, 4, 5)] == [[], ["1"], ["1"], ["3"], ["3"], []]


@pytest.mark.parametrize("limit", [10**6, 2])
def test_each_attribute_has_intervals_of_its_own(spark, limit):
    rows = [(1, {"x": "1", "y": "a"}), (2, {"x": "1", "y": "b"}), (3, {"y": "b", "z": None}), (5, {"x": "1", "y": "b"})]
    states = spark.createDataFrame([(f"{c:040x}", "L", "a", "put", p, at(c), 0, 0) for c, p in rows] + [(f"{7:040x}", "L", "a", "delete", None, at(7), 0, 0)], STATES)
    log = attribute_log(states, commits(spark, 9), KEYS, rows_per_task=limit)
    hour = lambda t: int((t - T0).total_seconds() // 3600)
    got = sorted((r["attr"] or "", r["value"], hour(r["valid_from"]), hour(r["valid_to"])) for r in log.collect())
    assert got == [("", "", 1, 7), ("x", "1", 1, 3), ("x", "1", 5, 7), ("y", "a", 1, 2), ("y", "b", 2, 7)]
