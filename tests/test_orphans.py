import random
from datetime import datetime, timedelta

import pytest

from graphloam.operators.orphans import cascade, dangling, orphans, report

T0 = datetime(2024, 1, 1)
REFS = "label string, node_key string, at timestamp, rec int, until string, t int"
LIVES = "label string, node_key string, b timestamp, e timestamp, at int, rec string"


def h(i):
    return None if i is None else T0 + timedelta(hours=i)


def run(spark, refs, lives, limit=10**6):
    r = spark.createDataFrame([("L", k, h(t), i, "clash", 0) for i, (k, t) in enumerate(refs)], REFS)
    s = spark.createDataFrame([("L", k, h(b), h(e), 0, "clash") for k, b, e in lives], LIVES)
    out = dangling(r, s, ["label", "node_key"], at="at", begins="b", ends="e", rows_per_task=limit)
    assert out.columns == ["label", "node_key", "at", "rec", "until", "t", "reason"]
    return sorted((x["rec"], x["reason"]) for x in out.collect())


def test_reasons(spark):
    lives = [("a", 2, 5), ("a", 2, 5), ("a", 4, 6), ("a", 9, None), ("b", 1, None), (None, 0, None), ("c", None, None)]
    refs = [("a", 1), ("a", 2), ("a", 5), ("a", 6), ("a", 8), ("a", 9), ("b", 0), ("b", 99), ("zz", 3), (None, 3), ("b", None), ("c", 1), ("a", 6)]
    assert run(spark, refs, lives) == [(0, "early"), (3, "ended"), (4, "ended"), (6, "early"), (8, "missing"), (10, "undated"), (11, "missing"), (12, "ended")]
    assert run(spark, [], lives) == [] and run(spark, refs[:1], []) == [(0, "missing")]


@pytest.mark.parametrize("limit", [10**6, 15])
def test_random_against_brute_force(spark, limit):
    rng = random.Random(3)
    lives = [(rng.choice(["hot", "hot", "a", "b"]), b, rng.choice([None, b + rng.randint(1, 9)]) if b > 80 else b + rng.randint(1, 4)) for b in (rng.randint(0, 99) for _ in range(90))]
    refs = [(rng.choice(["hot"] * 6 + ["a", "b", "none"]), rng.choice([None] + list(range(100)))) for _ in range(400)]
    want = []
    for i, (k, t) in enumerate(refs):
        own = [(b, e) for x, b, e in lives if x == k]
        if t is None:
            want.append((i, "undated"))
        elif not any(b <= t and (e is None or t < e) for b, e in own):
            want.append((i, "ended" if any(b <= t for b, _ in own) else "early" if own else "missing"))
    assert run(spark, refs, lives, limit) == want


def test_cascade_levels_cycles_and_report(spark):
    direct = spark.createDataFrame([("t", 1), ("t", 1), ("t", None)], "tbl string, rec_id bigint")
    links = [("u", 10, "t", 1), ("u", 10, "t", 1), ("v", 20, "u", 10), ("u", 11, "v", 20), ("v", 20, "u", 11), ("v", 21, "t", 2), ("t", 1, "v", 20), ("v", None, "t", 1)]
    got = cascade(direct, spark.createDataFrame(links, "child_tbl string, child_id bigint, parent_tbl string, parent_id bigint"))
    assert sorted(tuple(r) for r in got.collect()) == [("t", 1, "direct", 0), ("u", 10, "inherited", 1), ("u", 11, "inherited", 3), ("v", 20, "inherited", 2)]
    records = spark.createDataFrame([("t", 1, "p"), ("t", 1, "p"), ("t", 2, "p"), ("u", 10, "p"), ("u", 11, "q")], "tbl string, rec_id bigint, period string")
    assert sorted(tuple(r) for r in report(direct, got, records).collect()) == [("t", "p", 2, 2, 1, 0), ("u", "p", 1, 0, 0, 1), ("u", "q", 1, 0, 0, 1)]
    with pytest.raises(RuntimeError):
        cascade(direct, spark.createDataFrame([("u", i + 1, "u", i) for i in range(5)] + [("u", 0, "t", 1)], "child_tbl string, child_id bigint, parent_tbl string, parent_id bigint"), max_rounds=3)


def test_orphans_from_references_down_three_levels(spark):
    """x refers to nothing, y to x, z to y; w refers to a node that lives."""
    refs = spark.createDataFrame([("L", "gone", h(1), "t", 1), ("L", "here", h(1), "t", 9), ("L", "gone", h(1), "t", 1)], "label string, node_key string, at timestamp, tbl string, rec_id bigint")
    lives = spark.createDataFrame([("L", "here", h(0), None)], "label string, node_key string, b timestamp, e timestamp")
    links = spark.createDataFrame([("u", 2, "t", 1), ("v", 3, "u", 2), ("w", 4, "v", 3), ("w", 5, "t", 9)], "child_tbl string, child_id bigint, parent_tbl string, parent_id bigint")
    got = orphans(refs, lives, ["label", "node_key"], links, at="at", begins="b", ends="e")
    assert sorted({(r["tbl"], r["rec_id"], r["node_key"], r["reason"], r["kind"], r["level"]) for r in got.collect()}) == [("t", 1, "gone", "missing", "direct", 0), ("u", 2, None, None, "inherited", 1), ("v", 3, None, None, "inherited", 2), ("w", 4, None, None, "inherited", 3)]
    none = orphans(refs.limit(0), lives, ["label", "node_key"], links, at="at", begins="b", ends="e")
    assert none.collect() == []
