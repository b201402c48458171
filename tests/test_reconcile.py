import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloam.operators import gf61, reconcile as rc

T0 = datetime(2024, 1, 1)
DDL = "side string, label string, rec_key string, rec string, loaded_at timestamp, bucket int, h string"


def test_field_arithmetic():
    rng = random.Random(1)
    a = [rng.randrange(gf61.P) for _ in range(2000)] + [0, 1, gf61.P - 1, gf61.P - 1]
    b = [rng.randrange(gf61.P) for _ in range(2000)] + [5, gf61.P - 1, gf61.P - 1, 1]
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    assert gf61.mul(x, y).tolist() == [i * j % gf61.P for i, j in zip(a, b)]
    assert gf61.add(x, y).tolist() == [(i + j) % gf61.P for i, j in zip(a, b)]
    assert gf61.sub(x, y).tolist() == [(i - j) % gf61.P for i, j in zip(a, b)]
    nonzero = x[x != 0]
    assert (gf61.mul(nonzero, gf61.inverse(nonzero)) == 1).all()
    groups = np.array([1, 1, 1, 2, 3, 3])
    g, p = gf61.products(groups, x[:6, None])
    assert g.tolist() == [1, 2, 3] and p[:, 0].tolist() == [a[0] * a[1] * a[2] % gf61.P, a[3], a[4] * a[5] % gf61.P]


def elements(spark, ours, theirs):
    rows = [(b, True, h) for b, h in ours] + [(b, False, h) for b, h in theirs]
    return spark.createDataFrame(rows, "bucket bigint, ours boolean, h bigint")


@pytest.mark.parametrize("bound", [1, 2, 16])
def test_sets_of_any_difference(spark, bound):
    """Buckets with no, few, one-sided and only differences, up to far above the first bound."""
    rng = random.Random(2)
    ours, theirs = set(), set()
    for bucket, (common, a, b) in enumerate([(50, 0, 0), (50, 1, 0), (50, 0, 1), (40, 3, 2), (0, 30, 30), (0, 25, 0), (0, 0, 9), (20, 8, 8), (5, 40, 1)]):
        draw = lambda n: {(bucket, rng.randrange(1 << 60)) for _ in range(n)}
        same = draw(common)
        ours |= same | draw(a)
        theirs |= same | draw(b)
    got = {(r["bucket"], r["ours"], r["h"]) for r in rc.differing(elements(spark, ours, theirs), first_bound=bound).collect()}
    assert got == {(b, True, h) for b, h in ours - theirs} | {(b, False, h) for b, h in theirs - ours}


def compare(spark, rows, **kw):
    df = spark.createDataFrame([(*r, T0.replace(hour=i % 24), 0, "clash") if len(r) == 4 else (*r, 0, "clash") for i, r in enumerate(rows)], DDL)
    return [tuple(r) for r in rc.compare_copies(df, **kw).collect()]


def test_values(spark):
    both = lambda k, o, t: [("ours", "L", k, o), ("theirs", "L", k, t)]
    rows = [
        *both("same", '{"a":1.50,"b":"x","c":null}', ' {"b" : "\\u0078" ,\n "a" : 15e-1}'),
        *both("big", '{"n":9223372036854775807}', '{"n":9223372036854775806}'),
        *both("type", '{"a":"1","b":true}', '{"a":1,"b":"true"}'),
        *both("gone", '{"a":1,"b":2}', '{"a":1}'),
        *both("case", '{"a":"X "}', '{"a":"X"}'),
        *both("zero", '{"a":0.0}', '{"a":-0e9}'),
        *both("deep", '{"a":[1,{"x":1.0,"y":2}]}', '{"a":[1.0,{"y":2,"x":1}]}'),
        *both("null", None, "{}"),
        *both("broken", "{oops", "{}"),
        ("ours", "L", "mine", "{}"),
        ("theirs", "L", "yours", "{}"),
        ("base", "L", "gone", '{"b":3}'),
        ("base", "L", "only base", '{"b":3}'),
        ("ours", None, "x", "{}"),
        ("other", "L", "gone", "{}"),
    ]
    assert set(compare(spark, rows)) == set(
        [
            ("L", "big", "n", "differs", None, "9223372036854775807", "9223372036854775806"),
            ("L", "type", "a", "differs", None, "1", "1"),
            ("L", "type", "b", "differs", None, "true", "true"),
            ("L", "gone", "b", "differs", "3", "2", None),
            ("L", "case", "a", "differs", None, "X ", "X"),
            ("L", "broken", "", "differs", None, "{oops", None),
            ("L", "mine", "", "only_ours", None, None, None),
            ("L", "yours", "", "only_theirs", None, None, None),
        ]
    )


def test_repeated_records_and_empty(spark):
    rows = [("ours", "L", "k", '{"a":1}', T0), ("ours", "L", "k", '{"a":2}', T0.replace(hour=3)), ("ours", "L", "k", '{"a":2.0}', T0.replace(hour=2)), ("theirs", "L", "k", '{"a":2}', None)]
    assert compare(spark, rows) == []
    assert compare(spark, [("base", "L", "k", "{}")]) == []
    assert compare(spark, [("ours", "L", "k", '{"a":"%s"}' % ("x" * 200_000)), ("theirs", "L", "k", '{"a":"y"}')])[0][2] == "a"


def test_many_differences_in_one_bucket(spark):
    rows = [("ours", "L", f"k{i}", '{"v":%d}' % i) for i in range(300)] + [("theirs", "L", f"k{i}", '{"v":%d}' % (i if i % 3 else -i - 1)) for i in range(0, 300, 1)]
    got = compare(spark, rows, records_per_bucket=1000, first_bound=4)
    assert {r[1] for r in got} == {f"k{i}" for i in range(0, 300, 3)}
