"""Differences between two copies of a data set, field by field.

Each record becomes one hash of its canonical form.  Keys are dealt into
buckets; of each bucket and side only the values of the characteristic
polynomial (the product of z - hash) at a few points are gathered.  The quotient
of both sides' polynomials is a rational function whose degree is the number of
differences, so a few points recover it exactly however many records agree.  Two
further points verify it; the bound on the degree doubles for buckets that
fail.  The roots of numerator and denominator are the hashes of the differing
records; those records alone are fetched and compared field by field.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloam.operators import gf61
from graphloam.session import materialize

RECORDS_PER_BUCKET = 64
STEPS_PER_TASK = 2_500_000
MAX_TASKS = 10_000
FIRST_BOUND = 16
CHECKS = 2
HASH_BITS = 60  # points of evaluation lie above every hash

_NUMBER = re.compile(r"(-?)(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?")


# -- canonical records -------------------------------------------------------


def _number(text: str) -> str:
    """One spelling for each exact number."""
    sign, whole, fraction, exponent = _NUMBER.fullmatch(text).groups()
    digits = (whole + (fraction or "")).lstrip("0")
    if not digits:
        return "n0"
    short = digits.rstrip("0")
    return f"n{sign}{short}e{int(exponent or 0) - len(fraction or '') + len(digits) - len(short)}"


class _Number(str):
    pass


def _refuse(token: str):
    raise ValueError(token)


_DECODER = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_refuse, strict=False)


def _value(v) -> str:
    """Type and value as a text that is equal just for equal values."""
    if isinstance(v, _Number):
        return _number(v)
    if isinstance(v, str):
        return "s" + v
    if isinstance(v, bool):
        return "btrue" if v else "bfalse"
    if v is None:
        return "z"
    if isinstance(v, list):
        return "l" + json.dumps([_value(x) for x in v])
    return "o" + json.dumps(sorted((k, _value(x)) for k, x in v.items()))


def _shown(v) -> str:
    return str(v) if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def canonical(rec: str | None) -> dict[str, tuple[str, str]]:
    """Present properties with canonical value and text to show."""
    if rec is None:
        return {}
    try:
        found = _DECODER.decode(rec)
    except (ValueError, RecursionError):
        found = None
    if not isinstance(found, dict):
        return {"": ("x" + rec, rec)}
    return {k: (_value(v), _shown(v)) for k, v in found.items() if v is not None}


def record_hash(label: str, key: str, props: dict[str, tuple[str, str]]) -> int:
    h = hashlib.blake2b(digest_size=8)
    for part in (label, key, *(x for k in sorted(props) for x in (k, props[k][0]))):
        data = part.encode("utf-8", "surrogatepass")
        h.update(len(data).to_bytes(8, "little") + data)
    return int.from_bytes(h.digest(), "little") >> (64 - HASH_BITS)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        label, key, rec = (b.column(i).to_pylist() for i in (1, 2, 3))
        h = np.array([record_hash(x, k, canonical(r)) for x, k, r in zip(label, key, rec)], dtype="int64")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array(h, pa.int64())], names=["side", "label", "rec_key", "loaded", "h"])


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = pa.map_(pa.string(), pa.string())
    for b in batches:
        label, key, rec = (b.column(i).to_pylist() for i in (1, 2, 3))
        props = [canonical(r) for r in rec]
        h = [record_hash(x, k, p) for x, k, p in zip(label, key, props)]
        maps = [pa.array([[(_clean(k), _clean(v[i])) for k, v in p.items()] for p in props], texts) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array(h, pa.int64()), *maps], names=["side", "label", "rec_key", "loaded", "h", "values", "texts"])


def _clean(text: str) -> str:
    """Lone surrogates, which JSON can spell, are no UTF-8: keep them visible."""
    return text if text.isascii() else text.encode("utf-8", "backslashreplace").decode()


# -- set reconciliation ------------------------------------------------------


def _points(n: int) -> np.ndarray:
    return np.uint64(gf61.P - 1) - np.arange(n, dtype=np.uint64)


def _evaluated(bound: int):
    """Values of each bucket's characteristic polynomials, one row for each
    bucket and side in a batch; products combine them later."""
    points = _points(bound + CHECKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 21) // len(points))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                bucket, ours, h = b.column(0).to_numpy().astype("int64"), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy().astype(np.uint64)
                group = bucket * 2 + ours
                order = np.argsort(group, kind="stable")
                values = gf61.sub(points[None, :], h[order][:, None])
                groups, values = gf61.products(group[order], values)
                counts = np.unique(group, return_counts=True)[1]
                flat = pa.array(values.ravel().astype("int64"))
                offsets = pa.array((np.arange(len(groups) + 1) * len(points)).astype("int32"))
                yield pa.RecordBatch.from_arrays([pa.array(groups // 2), pa.array((groups % 2).astype(bool)), pa.array(counts), pa.ListArray.from_arrays(offsets, flat)], names=["bucket", "ours", "n", "vals"])

    return run


def _combine(parts: list[list[dict]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts and values of ours and theirs for each bucket."""
    n = np.zeros((2, len(parts)), int)
    vals = np.ones((2, len(parts), width), np.uint64)
    for i, rows in enumerate(parts):
        for r in rows:
            s = 0 if r["ours"] else 1
            n[s, i] += r["n"]
            vals[s, i] = gf61.mul(vals[s, i], np.array(r["vals"], np.uint64))
    return n[0], n[1], vals[0], vals[1]


def _system(f: np.ndarray, z: np.ndarray, da: np.ndarray, db: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sum a_j z^j - f sum b_j z^j = f z^db - z^da for every point."""
    most = int(max(da.max(initial=0), db.max(initial=0)))
    powers = np.ones((len(z), most + 1), np.uint64)
    for j in range(1, most + 1):
        powers[:, j] = gf61.mul(powers[:, j - 1], z)
    wa, wb = int(da.max(initial=0)), int(db.max(initial=0))
    num = np.where(np.arange(wa)[None, None, :] < da[:, None, None], powers[None, :, :wa], np.uint64(0))
    den = gf61.sub(np.zeros(1, np.uint64), gf61.mul(f[:, :, None], powers[None, :, :wb]))
    den = np.where(np.arange(wb)[None, None, :] < db[:, None, None], den, np.uint64(0))
    right = gf61.sub(gf61.mul(f, powers[:, db].T), powers[:, da].T)
    return np.concatenate([num, den], axis=2), right


def interpolate(na: np.ndarray, nb: np.ndarray, va: np.ndarray, vb: np.ndarray, bound: int):
    """For each bucket whether the bound holds, and the reduced polynomials of
    what only ours and what only theirs has (coefficients and degrees)."""
    z, count = _points(bound + CHECKS), len(na)
    delta = na - nb
    ok = np.abs(delta) <= bound
    da = np.where(ok, (bound + delta) // 2, 0)
    db = np.where(ok, da - delta, 0)
    f = gf61.mul(va, gf61.inverse(vb.ravel()).reshape(vb.shape))
    for again in (False, True):  # first the rank, which tells the true degrees, then the one solution
        matrix, right = _system(f[:, :bound], z[:bound], da, db)
        solution, rank, consistent = gf61.solve(matrix, right)
        if not again:
            spare = da + db - rank
            ok &= consistent & (spare <= np.minimum(da, db))
            da, db = np.where(ok, da - spare, 0), np.where(ok, db - spare, 0)
    ok &= consistent & (rank == da + db)
    wa = int(da.max(initial=0))
    p, q = solution[:, :wa], solution[:, wa:]
    for i in range(bound, bound + CHECKS):
        x = np.full(count, z[i])
        ok &= gf61.mul(gf61.horner(p, da, x), vb[:, i]) == gf61.mul(gf61.horner(q, db, x), va[:, i])
    return ok, p, da, q, db


def _solved(bound: int):
    width = bound + CHECKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 19) // (width * width))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                ok, p, da, q, db = interpolate(*_combine(b.column(1).to_pylist(), width), bound)
                lists = lambda c, d: pa.array([x[:k].astype("int64").tolist() for x, k in zip(c, d)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ok), lists(p, da), lists(q, db)], names=["bucket", "ok", "p", "q"])

    return run


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose hash is a root of their own side's polynomial."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            b = batch.slice(at, 4096)
            poly = b.column(3)
            degree = np.diff(poly.offsets.to_numpy())
            flat = poly.flatten().to_numpy().astype(np.uint64)
            table = np.zeros((b.num_rows, int(degree.max(initial=0))), np.uint64)
            row = np.repeat(np.arange(b.num_rows), degree)
            table[row, np.arange(len(flat)) - np.repeat(np.cumsum(degree) - degree, degree)] = flat
            root = gf61.horner(table, degree, b.column(2).to_numpy().astype(np.uint64)) == 0
            yield pa.RecordBatch.from_arrays([b.column(i) for i in (0, 1, 2)], names=["bucket", "ours", "h"]).filter(pa.array(root & (degree > 0)))


def differing(elements: DataFrame, buckets: int | None = None, *, first_bound: int = FIRST_BOUND) -> DataFrame:
    """Elements (``bucket, ours, h``; each at most once) that one side alone has.

    Every round gathers ``bound`` values for each bucket that isn't solved yet.
    A bucket is solved when both check points hold and when each polynomial has
    as many roots among the rows as its degree.  Its bound can't pass the number
    of its rows on both sides, at which every quotient is determined.  Solving
    takes bound^3 steps a bucket, so the number of buckets (*buckets*, or
    counted) and the bound, not bytes, give the number of tasks.
    """
    buckets = elements.select("bucket").distinct().count() if buckets is None else buckets
    bound, pending, found = first_bound, elements, None
    while True:
        partial = pending.select("bucket", "ours", "h").mapInArrow(_evaluated(bound), "bucket bigint, ours boolean, n bigint, vals array<bigint>")
        tasks = min(MAX_TASKS, max(1, math.ceil(buckets * bound**3 / STEPS_PER_TASK)))
        gathered = partial.repartition(tasks, "bucket").groupBy("bucket").agg(F.collect_list(F.struct("ours", "n", "vals")).alias("parts"))
        solved = materialize(gathered.mapInArrow(_solved(bound), "bucket bigint, ok boolean, p array<bigint>, q array<bigint>"), "reconcile-solved")
        with_poly = pending.join(solved.filter("ok and (size(p) > 0 or size(q) > 0)"), "bucket").select("bucket", "ours", "h", F.when(F.col("ours"), F.col("p")).otherwise(F.col("q")).alias("poly"))
        roots = materialize(with_poly.mapInArrow(_rooted, "bucket bigint, ours boolean, h bigint"), "reconcile-roots")
        counted = roots.groupBy("bucket").agg(F.count_if("ours").alias("a"), F.count_if(~F.col("ours")).alias("b"))
        checked = solved.join(counted, "bucket", "left").select("bucket", (F.col("ok") & (F.size("p") == F.coalesce("a", F.lit(0))) & (F.size("q") == F.coalesce("b", F.lit(0)))).alias("ok"))
        checked = materialize(checked, "reconcile-checked")
        good = roots.join(checked.filter("ok"), "bucket", "left_semi")
        found = good if found is None else found.unionByName(good)
        open_buckets = checked.filter("not ok")
        buckets = open_buckets.count()
        if not buckets:
            return found
        bound *= 2
        pending = materialize(pending.join(open_buckets, "bucket", "left_semi"), "reconcile-pending")


def compare_copies(
    copies: DataFrame, *, side: str = "side", label: str = "label", key: str = "rec_key", record: str = "rec", loaded: str = "loaded_at", ours: str = "ours", theirs: str = "theirs", base: str = "base", first_bound: int = FIRST_BOUND, records_per_bucket: int = RECORDS_PER_BUCKET
) -> DataFrame:
    """Records on one side alone, and each property whose value differs.

    Result: ``label, rec_key, prop, kind, base, ours, theirs``: kind
    ``only_ours`` or ``only_theirs`` (prop '') or ``differs``; the last three show
    the values (null where absent; for whole records null).

    A null property counts as absent, a null record as one without properties;
    of a name twice in an object the last holds.  Values are equal if type and
    value are; numbers compare exactly.  A text that is no JSON object is a record
    with one property '' holding that text.  Of several different records of one
    key on a side the one loaded last holds, then the one of the greater hash;
    repeated ones vanish.  Rows with a null label or key are no record and are
    left out, as are other sides and further columns.  Hashes have 60 bits within
    a bucket: two different records of one key are taken for equal with a chance
    of 2^-60.
    """
    rows = copies.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(
        F.col(side).alias("side"), F.col(label).alias("label"), F.col(key).alias("rec_key"), F.col(record).alias("rec"), F.col(loaded).alias("loaded")
    )
    schema = copies.schema
    kind = schema[loaded].dataType.simpleString()
    both = rows.filter(F.col("side").isin(ours, theirs))
    buckets = max(1, round(copies.count() / records_per_bucket / 2))
    hashed = both.mapInArrow(_hashed, f"side string, label string, rec_key string, loaded {kind}, h bigint")
    latest = hashed.groupBy("side", "label", "rec_key").agg(F.max(F.struct("loaded", "h"))["h"].alias("h"))
    elements = latest.select(F.pmod(F.xxhash64("label", "rec_key"), F.lit(buckets)).alias("bucket"), (F.col("side") == ours).alias("ours"), "h", "label", "rec_key")
    elements = materialize(elements.repartition("bucket").sortWithinPartitions("bucket"), "reconcile-elements")
    lost = differing(elements, buckets, first_bound=first_bound)
    # fetch what differs, with the base beside it
    wanted = elements.join(lost, ["bucket", "ours", "h"], "left_semi").select("label", "rec_key").distinct()
    fetched = rows.filter(F.col("side").isin(ours, theirs, base)).join(wanted, ["label", "rec_key"], "left_semi").select("side", "label", "rec_key", "rec", "loaded")
    fields = fetched.mapInArrow(_fields, f"side string, label string, rec_key string, loaded {kind}, h bigint, values map<string,string>, texts map<string,string>")
    last = lambda s, n: F.max_by(F.when(F.col("side") == s, F.struct("values", "texts")), F.when(F.col("side") == s, F.struct("loaded", "h"))).alias(n)
    side_by_side = fields.groupBy("label", "rec_key").agg(last(ours, "o"), last(theirs, "t"), last(base, "b"))
    none = F.lit(None).cast("string")
    alone = side_by_side.filter("o is null or t is null").select("label", "rec_key", F.lit("").alias("prop"), F.when(F.col("t").isNull(), "only_ours").otherwise("only_theirs").alias("kind"), none.alias("base"), none.alias("ours"), none.alias("theirs"))
    # explode the fields that differ
    names = F.array_union(F.map_keys("o.values"), F.map_keys("t.values"))
    pairs = side_by_side.filter("o is not null and t is not null").select("label", "rec_key", "o", "t", "b", F.explode(names).alias("prop"))
    at = lambda s, m: F.try_element_at(F.col(f"{s}.{m}"), F.col("prop"))
    differs = pairs.filter(~at("o", "values").eqNullSafe(at("t", "values"))).select("label", "rec_key", "prop", F.lit("differs").alias("kind"), at("b", "texts").alias("base"), at("o", "texts").alias("ours"), at("t", "texts").alias("theirs"))
    return alone.unionByName(differs)
