"""References to records that do not exist.

Two steps.  ``dangling`` finds the references whose target isn't there at the
time of reference: references and the lives of their targets are merged in one
pass in order of time, per target, holding the latest end of any life begun so
far.  ``cascade`` goes on down the graph of foreign keys: a record is an orphan
directly if one of its own references dangles, and inherits it if a record it
refers to is an orphan; semi-joins repeat from the newest orphans until none is
added.  ``orphans`` is both together, from the references on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from graphloam.operators.hotkeys import BUCKET, ROWS_PER_TASK, carried, find_hot, with_buckets
from graphloam.session import materialize

SALTS = 16
FOREVER = "timestamp'9999-12-31 00:00:00'"


def dangling(references: DataFrame, lives: DataFrame, keys: list[str], *, at: str, begins: str, ends: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """References without a target at their time.

    *references* has the columns *keys* (what is referred to), *at* and any
    others, all returned; *lives* has *keys*, *begins* and *ends* (null: lives
    on).  A target exists if some life has ``begins <= at < ends``.  ``reason``
    is ``missing`` (the key never lives), ``ended`` (a life began before and none
    is left) or ``early`` (its lives begin later).

    A reference with a null key is no reference; one with a null time has no
    target (``undated``).  Lives without key or beginning exist at no time;
    repeated and overlapping lives are fine.  Lives are many per key or few:
    a key with many rows on either side is cut along time, so neither side is
    ever joined pair by pair.
    """
    named = " and ".join(f"`{k}` is not null" for k in keys)
    payload = [c for c in references.columns if c not in keys and c != at]
    nothing = [F.lit(None).cast(references.schema[c].dataType).alias(f"r_{c}") for c in payload]
    refs = references.filter(named).select(*keys, F.col(at).alias("t"), F.lit(None).cast("timestamp").alias("until"), F.lit(1).alias("is_ref"), *[F.col(c).alias(f"r_{c}") for c in payload])
    spans = lives.filter(named).filter(F.col(begins).isNotNull()).groupBy(*keys, begins).agg(F.max(F.coalesce(F.col(ends), F.expr(FOREVER))).alias("until"))
    spans = spans.select(*keys, F.col(begins).alias("t"), "until", F.lit(0).alias("is_ref"), *nothing)
    hot = find_hot(references.filter(named).select(*keys).unionAll(lives.filter(named).select(*keys)), keys, rows_per_task)
    events = refs.unionAll(spans)

    def scanned(rows: DataFrame, part: list[str]) -> DataFrame:
        along = W.partitionBy(*part).orderBy("t", "is_ref").rowsBetween(W.unboundedPreceding, 0)
        whole = W.partitionBy(*part)
        return rows.withColumn("reach", F.max("until").over(along)).withColumn("lives", F.max("until").over(whole).isNotNull())

    if not hot:
        seen = scanned(events, keys)
    else:
        part = [*keys, BUCKET]
        seen = scanned(hot.without(events), keys)
        split = materialize(with_buckets(hot.only(events).filter("t is not null"), hot, "t"), "orphans-hot")
        ends_by = split.groupBy(*part).agg(F.max("until").alias("end"))
        before = carried(ends_by, keys, F.max("end"), "before")
        ever = ends_by.groupBy(*keys).agg(F.max("end").isNotNull().alias("ever"))
        late = scanned(split, part).join(F.broadcast(before), part, "left").join(F.broadcast(ever), keys, "left")
        late = late.withColumn("reach", F.greatest("reach", "before")).withColumn("lives", F.coalesce("ever", F.lit(False)))
        undated = hot.only(events).filter("t is null").withColumn("reach", F.lit(None).cast("timestamp")).withColumn("lives", F.lit(True))
        seen = seen.unionByName(late.select(*seen.columns)).unionByName(undated.select(*seen.columns))
    reason = F.when(F.col("t").isNull(), "undated").when(F.col("reach").isNotNull(), "ended").when(F.col("lives"), "early").otherwise("missing")
    lost = seen.filter("is_ref = 1 and (t is null or reach is null or reach <= t)")
    return lost.select(*keys, F.col("t").alias(at), *[F.col(f"r_{c}").alias(c) for c in payload], reason.alias("reason"))


def cascade(direct: DataFrame, links: DataFrame, *, max_rounds: int = 1_000) -> DataFrame:
    """Direct and inherited orphans.

    *direct*: ``tbl, rec_id`` of records with a dangling reference of their own.
    *links*: ``child_tbl, child_id, parent_tbl, parent_id`` between records
    (foreign keys that do resolve).  Result: ``tbl, rec_id, kind`` (``direct`` or
    ``inherited``) and ``level`` (0 for direct, else the least number of links to
    a direct orphan).  Cycles end, since a record is added once.  Null ids link
    nothing; repeated rows count once.  The links of a parent are spread over
    ``SALTS`` salts, under each of which the parent comes once, so no task gets all
    children of one parent.  ``max_rounds`` guards against chains so long that a
    round per link can't be meant; reaching it raises instead of leaving
    records out.
    """
    level = 0
    found = materialize(direct.filter("tbl is not null and rec_id is not null").select("tbl", "rec_id").distinct().withColumn("level", F.lit(0)), "cascade")
    links = links.filter("child_tbl is not null and child_id is not null and parent_tbl is not null and parent_id is not null")
    salt = F.pmod(F.xxhash64("child_tbl", "child_id"), F.lit(SALTS)).cast("int").alias("salt")
    links = materialize(links.select("child_tbl", "child_id", "parent_tbl", "parent_id", salt).distinct(), "cascade-links")
    frontier = found
    while not frontier.isEmpty():
        level += 1
        if level > max_rounds:
            raise RuntimeError(f"the cascade of orphans goes on after {max_rounds} rounds")
        parents = frontier.select(F.col("tbl").alias("parent_tbl"), F.col("rec_id").alias("parent_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        reached = links.join(parents.hint("merge"), ["parent_tbl", "parent_id", "salt"], "left_semi").select(F.col("child_tbl").alias("tbl"), F.col("child_id").alias("rec_id")).distinct()
        frontier = materialize(reached.join(found, ["tbl", "rec_id"], "left_anti").withColumn("level", F.lit(level)), "cascade")
        found = found.unionByName(frontier)
    return found.select("tbl", "rec_id", F.when(F.col("level") == 0, "direct").otherwise("inherited").alias("kind"), "level")


def orphans(references: DataFrame, lives: DataFrame, keys: list[str], links: DataFrame, *, at: str, begins: str, ends: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """All orphans of the graph of foreign keys, from the references on.

    *references* as for ``dangling``, with ``tbl, rec_id`` of the referring record
    among its columns; *links* as for ``cascade``.  Level 0 are the references
    without a target, one row each with all their columns and ``reason``; each
    further level are the records that refer to an orphan of the level before,
    with nulls for the columns of a reference.  ``kind`` is ``direct`` or
    ``inherited``.
    """
    lost = materialize(dangling(references, lives, keys, at=at, begins=begins, ends=ends, rows_per_task=rows_per_task), "dangling")
    found = cascade(lost, links)
    own = lost.withColumns({"kind": F.lit("direct"), "level": F.lit(0)})
    return own.unionByName(found.filter("level > 0"), allowMissingColumns=True)


def report(direct: DataFrame, orphans: DataFrame, records: DataFrame) -> DataFrame:
    """Per table and period: records, dangling references, records that are
    orphans directly and by inheritance.  *records*: ``tbl, rec_id, period``;
    *direct*: dangling references with ``tbl, rec_id``; each counted once
    however often its row is delivered."""
    each = records.select("tbl", "rec_id", "period").distinct()
    refs = direct.groupBy("tbl", "rec_id").agg(F.count(F.lit(1)).alias("refs"))
    joined = each.join(orphans.select("tbl", "rec_id", "kind"), ["tbl", "rec_id"], "left").join(refs, ["tbl", "rec_id"], "left")
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    return joined.groupBy("tbl", "period").agg(
        F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum("refs"), F.lit(0)).alias("n_dangling_refs"), count("direct").alias("n_direct"), count("inherited").alias("n_inherited")
    )
