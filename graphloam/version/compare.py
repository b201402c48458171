"""Differences and three-way merges of keyed tables, as outer joins on the key.

A record is a row; properties are all columns but the keys.  A null property is
an absent one.  Keys must be unique per table; the joins are by key alone, so no
row meets more than one other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

ADDED, REMOVED, MODIFIED = "added", "removed", "modified"


def _q(side: str, name: str) -> Column:
    return F.col(f"{side}.`{name}`")


def _aligned(frames: list[DataFrame], keys: list[str]) -> tuple[list[DataFrame], list[str]]:
    """The frames with the columns of all of them; a column that has different
    types is compared as text."""
    kinds: dict[str, list] = {}
    for f in frames:
        for x in f.schema.fields:
            kinds.setdefault(x.name, []).append(x.dataType)
    out = []
    for f in frames:
        have = set(f.columns)
        cols = []
        for name, types in kinds.items():
            one = types[0] if all(t == types[0] for t in types) else None
            kind = one.simpleString() if one is not None else "string"
            cols.append((F.col(f"`{name}`") if name in have else F.lit(None)).cast(kind).alias(name))
        out.append(f.select(*cols, F.lit(True).alias("__here")))
    return out, [x for x in kinds if x not in keys]


def _text(col: Column, kind: str) -> Column:
    return col if kind == "string" else F.to_json(col) if kind.startswith(("array", "map", "struct")) else col.cast("string")


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Records that differ: the keys, ``change``, ``properties`` (names of those
    that differ, sorted; all that are present for added and removed records),
    ``before`` and ``after`` (maps of texts of these properties).

    Rows with a null in the key are compared like any other key.  Equal
    tables and empty ones give no rows; a column on one side only counts as
    null on the other.
    """
    (a, b), props = _aligned([old, new], keys)
    on = None
    for k in keys:
        one = _q("o", k).eqNullSafe(_q("n", k))
        on = one if on is None else on & one
    joined = a.alias("o").join(b.alias("n"), on, "full")
    kinds = {f.name: f.dataType.simpleString() for f in a.schema.fields}
    cells = [F.when(~_q("o", p).eqNullSafe(_q("n", p)), F.struct(F.lit(p).alias("key"), _text(_q("o", p), kinds[p]).alias("o"), _text(_q("n", p), kinds[p]).alias("n"))) for p in sorted(props)]
    differ = F.filter(F.array(*cells), lambda x: x.isNotNull()) if cells else F.array().cast("array<struct<key:string,o:string,n:string>>")
    change = F.when(_q("o", "__here").isNull(), ADDED).when(_q("n", "__here").isNull(), REMOVED).when(F.size("d") > 0, MODIFIED)
    side = lambda s: F.map_from_entries(F.transform(F.filter("d", lambda x: x[s].isNotNull()), lambda x: F.struct(x["key"], x[s].alias("value"))))
    found = joined.withColumn("d", differ).withColumn("change", change).filter("change is not null")
    return found.select(*[F.coalesce(_q("o", k), _q("n", k)).alias(k) for k in keys], "change", F.transform("d", lambda x: x["key"]).alias("properties"), side("o").alias("before"), side("n").alias("after"))


@dataclass
class Merged:
    records: DataFrame
    conflicts: DataFrame


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], *, sets: tuple[str, ...] = ()) -> Merged:
    """Three-way merge, cell by cell.

    A record changed on one side only takes that side; one deleted on a side and
    unchanged on the other goes.  Changed on both, each property takes the side
    that changed it, or the value both agree on; a property changed to two values
    is left out and is a conflict.  A record both sides add is merged against an
    empty one.  Deleted on one side and changed on the other, it is a conflict of
    the whole record (``property`` null), and the result holds it as in base.
    Columns in *sets* are merged as sets: nothing is lost that a side kept or
    added, and nothing stays that a side removed.

    ``records`` has the columns of all three tables.  ``conflicts`` has the keys,
    ``property``, ``base, ours, theirs`` (texts; of a whole record its
    properties as JSON).
    """
    (b, o, t), props = _aligned([base, ours, theirs], keys)
    on = lambda x, y: _all([F.coalesce(*[_q(s, k) for s in x]).eqNullSafe(_q(y, k)) for k in keys])
    joined = b.alias("b").join(o.alias("o"), on(["b"], "o"), "full").join(t.alias("t"), on(["b", "o"], "t"), "full")
    kinds = {f.name: f.dataType.simpleString() for f in b.schema.fields}
    pb, po, pt = (_q(s, "__here").isNotNull() for s in "bot")
    same = lambda x, y: _all([_q(x, p).eqNullSafe(_q(y, p)) for p in props])
    plain = [p for p in props if p not in sets]
    cell = {}
    for p in plain:
        x, y, z = (_q(s, p) for s in "bot")
        clash = ~y.eqNullSafe(z) & ~y.eqNullSafe(x) & ~z.eqNullSafe(x)
        cell[p] = (F.when(y.eqNullSafe(z), y).when(y.eqNullSafe(x), z).when(z.eqNullSafe(x), y), clash)
    for p in sets:
        x, y, z = (F.coalesce(_q(s, p), F.array().cast(kinds[p])) for s in "bot")
        kept = F.array_intersect(F.array_intersect(x, y), z)
        both = F.array_sort(F.array_union(kept, F.array_union(F.array_except(y, x), F.array_except(z, x))))
        cell[p] = (F.when(F.size(both) > 0, both), F.lit(False))
    gone_ours, gone_theirs = pb & ~po & pt, pb & po & ~pt
    whole = (gone_ours & ~same("b", "t")) | (gone_theirs & ~same("b", "o"))
    lives = (po & pt) | (~pb & (po | pt)) | whole
    value = lambda p: F.when(whole, _q("b", p)).when(po & pt, cell[p][0]).when(po, _q("o", p)).otherwise(_q("t", p))
    key = [F.coalesce(*[_q(s, k) for s in "bot"]).alias(k) for k in keys]
    records = joined.filter(lives).select(*key, *[value(p).alias(p) for p in props])
    text = lambda s, p: _text(_q(s, p), kinds[p])
    record = lambda s: F.when(_q(s, "__here").isNotNull(), F.to_json(F.struct(*[_q(s, p).alias(p) for p in sorted(props)])) if props else F.lit("{}"))
    entry = lambda p, x, y, z: F.struct(F.lit(p).cast("string").alias("property"), x.alias("base"), y.alias("ours"), z.alias("theirs"))
    clashes = [F.when(po & pt & cell[p][1], entry(p, text("b", p), text("o", p), text("t", p))) for p in sorted(plain)]
    clashes.append(F.when(whole, entry(None, record("b"), record("o"), record("t"))))
    found = joined.select(*key, F.explode(F.filter(F.array(*clashes), lambda x: x.isNotNull())).alias("c"))
    return Merged(records, found.select(*keys, "c.*"))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for x in conditions:
        out = out & x
    return out
