import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from graphloam.operators import quarantine as q

FEEDS = [("f", ",", ["a", "n", "b"], ["string", "int", "bool"]), ("t", "\t", ["a", "b"], ["string", "string"]), ("wide", "::", ["a", "n"], ["string", "int"])]
FEED_DDL = "feed string, sep string, column_names array<string>, column_types array<string>"
LINE_DDL = "line_id bigint, feed string, raw string, id string, value string, reason int"

GOOD = ["x,1,true", '"x","+1","false"', '"a,b\nc""d", -007 , true ', ",9223372036854775807,true", "﻿x,-9223372036854775808,false", '"",0,true', "a\\,1,true", "'x,2,true", "x,0000000000000000000000000000000001,true"]
BAD = {
    None: "no record",
    "": "1 cells instead of 3",
    "x,1": "2 cells instead of 3",
    "x,1,true,": "4 cells instead of 3",
    "x,,true": "column n: not an int",
    "x,1.0,true": "column n: not an int",
    "x,٣,true": "column n: not an int",
    "x,+,true": "column n: not an int",
    "x, 1,true": "column n: not an int",
    "x,9223372036854775808,true": "column n: int beyond 64 bits",
    "x,1,TRUE": "column b: not a bool",
    "x,1,": "column b: not a bool",
    'x"y,1,true': "quote in an unquoted cell",
    '"x"y,1,true': "text after a closing quote",
    '"x,1,true': "quote not closed",
    'x,1,"true': "quote not closed",
    "x\ny,1,true": "line break in an unquoted cell",
    "x,1,true\r": "line break in an unquoted cell",
}


def lines(spark, rows):
    return spark.createDataFrame([(i, f, r, "clash", "clash", 0) for i, (f, r) in enumerate(rows)], LINE_DDL)


def test_reasons_and_values(spark):
    rows = [("f", r) for r in GOOD] * 40 + [("f", r) for r in BAD] + [(None, "x"), ("nope", "x"), ("wide", "a::5"), ("wide", "a:5"), ("t", 'x\t"y\tz"')]
    got = {r["id"]: r for r in q.parse_lines(lines(spark, rows), spark.createDataFrame(FEEDS, FEED_DDL)).collect()}
    n = len(GOOD) * 40
    assert len(got) == len(rows) and all(got[i]["reason"] is None for i in range(n))
    assert [got[n + i]["reason"] for i in range(len(BAD))] == list(BAD.values())
    rest = [got[n + len(BAD) + i] for i in range(5)]
    assert [r["reason"] for r in rest] == ["no definition", "no definition", None, "1 cells instead of 2", None]
    assert rest[2]["value"]["n"]["int"] == 5 and rest[4]["value"]["b"]["text"] == "y\tz"
    two = got[2]["value"]
    assert (two["a"]["text"], two["n"]["int"], two["b"]["bool"]) == ('a,b\nc"d', -7, True)
    assert got[4]["value"]["a"]["text"] == "﻿x" and got[5]["value"]["a"]["text"] == ""


def test_typed_columns(spark):
    parsed = q.parse_lines(lines(spark, [("f", "x,1,true"), ("f", "bad")]), spark.createDataFrame(FEEDS, FEED_DDL))
    assert [tuple(r) for r in q.typed(parsed, FEEDS[0][2], FEEDS[0][3]).collect()] == [(0, "x", 1, True)]


def test_empty_and_long(spark):
    feeds = spark.createDataFrame(FEEDS, FEED_DDL)
    assert q.parse_lines(lines(spark, []), feeds).collect() == []
    long = "x" * 3_000_000
    got = q.parse_lines(lines(spark, [("f", f'"{long}",1,true'), ("f", long)]), feeds).collect()
    assert sorted((r["id"], r["reason"]) for r in got) == [(0, None), (1, "1 cells instead of 3")]
    with pytest.raises(ValueError):
        q.parse_lines(lines(spark, []), spark.createDataFrame(FEEDS[:1] * 2, FEED_DDL))


def test_endpoints(spark):
    labels = spark.createDataFrame([("Host", ["h"]), ("Two", ["a", "b"])], "label string, key_fields array<string>")
    cases = {"Host=x": None, "Host= x ,, ": None, "Two=a,b": None, "Host=a=b": None, "Host": "no =", "": "no =", None: "no text", "host=x": "not a label", " Host=x": "not a label", "Host=": "0 fields instead of 1", "Host=,": "0 fields instead of 1", "Host=a,b": "2 fields instead of 1", "Two=a": "1 fields instead of 2", "Host＝x": "no ="}
    specs = spark.createDataFrame([(i, s, 0) for i, s in enumerate(cases)], "spec_id bigint, spec string, id int")
    got = {r["id"]: r for r in q.parse_endpoints(specs, labels).collect()}
    assert [got[i]["reason"] for i in range(len(cases))] == list(cases.values())
    assert got[1]["value"]["fields"] == ["x"] and got[2]["value"]["fields"] == ["a", "b"] and got[3]["value"]["fields"] == ["a=b"]


cell = st.sampled_from(["", "a", "1", "-07", " 5", "true", " false ", '"', '""', '"q"', '"a,b"', "\n", "\r", "﻿", "x\ty", "+", "99999999999999999999", "é", "'"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(cell, min_size=1, max_size=4).map(",".join), min_size=1, max_size=12))
def test_block_path_equals_strict_reader(records):
    form = q.Delimited(",", ("a", "n", "b"), ("string", "int", "bool"))
    strict = []
    for r in records:
        try:
            strict.append(form.record(r))
        except q.Refused:
            strict = None
            break
    try:
        block = form.block(pa.array(records, pa.string()))
    except q.Refused:
        assert strict is None
    else:
        assert [list(x) for x in zip(*(c.to_pylist() for c in block))] == strict


endpoint = st.lists(st.sampled_from(["Host", "Two", "=", ",", " ", "a", " ", "b"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(endpoint, min_size=1, max_size=8))
def test_endpoint_block_equals_strict_reader(texts):
    form = q.Endpoint(("Host", "Two"), (1, 2))
    try:
        strict = [form.record(t) for t in texts]
    except q.Refused:
        strict = None
    try:
        block = [list(x) for x in zip(*(c.to_pylist() for c in form.block(pa.array(texts))))]
    except q.Refused:
        block = None
    assert block == strict
