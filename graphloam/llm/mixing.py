"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time: the tokens of its source up
to and with it, in shuffled order, divided by the weight of the source.  Reading
all copies by finish time serves the sources in proportion to their weights; a
source that has no copies left drops out and the others share its part.  The
mixture is the stretch up to the total budget.

Within a source the running sum goes over buckets, ranges of the shuffle's hash,
which spread evenly however large the source; there are at most
``MAX_BUCKETS`` of a pass, and only their sums are summed up in order.  The copies
of all sources are then sorted by finish time over range partitions of about
equal size, at most ``MAX_RANGES``; the budget ends in the one in which the sum of
the partitions before it reaches it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from graphloam.session import materialize

ROWS_PER_BUCKET = 50_000
MAX_SOURCES = 10_000
MAX_BUCKETS = 1 << 12
MAX_RANGES = 10_000
ORDER = ["finish", "source", "copy", "doc_id", "n_tokens"]


@dataclass
class _Source:
    name: str
    weight: float
    repeats: int
    rows: int
    tokens: int
    longest: int

    @property
    def limit(self) -> int:
        return self.tokens * self.repeats


def _virtual_time(sources: list[_Source], tokens: float) -> float:
    """The virtual time at which *tokens* are served."""
    time = served = 0.0
    active = sorted((s for s in sources if s.limit and s.weight > 0), key=lambda s: s.limit / s.weight)
    while active:
        rate = sum(s.weight for s in active)
        ends = active[0].limit / active[0].weight
        if served + (ends - time) * rate >= tokens:
            return time + (tokens - served) / rate
        served += (ends - time) * rate
        time, active = ends, active[1:]
    return time


def _sources(sized: DataFrame, targets: DataFrame) -> list[_Source]:
    named = targets.filter("source is not null and target_share > 0 and max_repeats > 0")
    named = named.groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r"), F.count(F.lit(1)).alias("k"))
    totals = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("m"))
    rows = named.join(totals, "source", "left").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if any(r["k"] > 1 for r in rows):
        raise ValueError("a source has two targets")
    return sorted((_Source(r["source"], r["w"], r["r"], r["n"] or 0, r["t"] or 0, r["m"] or 0) for r in rows), key=lambda s: s.name)


def mixture(sized: DataFrame, targets: DataFrame, *, budget: int | None = None, seed: int = 0, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The copies that make up the mixture.

    *sized*: ``doc_id, source, n_tokens``; *targets*: ``source, target_share,
    max_repeats``.  *budget* in tokens; by default the tokens of all sources
    that have a target.  Result: ``doc_id, source, copy`` (1 for the first use),
    ``n_tokens, finish``, in order of finish time, all copies whose running sum in
    that order is within the budget.  Each pass over a source is shuffled anew.

    Documents of a null source or one without a target are not mixed in; null
    sizes count as 0; repeated rows are documents of their own.  A source
    with two targets raises.  Empty inputs or a budget of 0 give documents
    without tokens at most.  Further columns are ignored.
    """
    spark = sized.sparkSession
    sized = sized.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
    sources = _sources(sized, targets)
    budget = sum(s.tokens for s in sources) if budget is None else budget
    # by this time the budget is reached for sure: no source is behind by more than one document
    latest = _virtual_time(sources, budget + sum(s.longest for s in sources))
    plan = []
    for s in sources:
        passes = s.repeats if not s.tokens else min(s.repeats, int(latest * s.weight // s.tokens) + 1)
        if s.rows:
            plan.append((s.name, s.weight, passes, min((s.rows // rows_per_bucket).bit_length(), MAX_BUCKETS.bit_length() - 1)))
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, weight double, passes int, bits int"))
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "copy", "doc_id"), 1)
    copies = sized.join(plan_df, "source").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("passes")))).withColumn("o", order)
    copies = copies.select("doc_id", "source", "n_tokens", "copy", "weight", "o", F.expr("shiftrightunsigned(o, 63 - bits)").alias("bucket"))
    part = ["source", "copy", "bucket"]
    sums = copies.groupBy(*part).agg(F.sum("n_tokens").alias("s"))
    before = W.partitionBy("source").orderBy("copy", "bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*part, F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy(*part).orderBy("o", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    served = copies.withColumn("run", F.sum("n_tokens").over(inside)).join(starts, part)
    rows = sum(s.rows * p[2] for s, p in zip((s for s in sources if s.rows), plan))
    finish = (F.col("start") + F.col("run")) / F.col("weight")
    timed = served.select("doc_id", "source", "copy", "n_tokens", finish.alias("finish"))
    ranges = min(MAX_RANGES, rows // rows_per_bucket + 1)
    ordered = timed.repartitionByRange(ranges, *ORDER).sortWithinPartitions(*ORDER).withColumn("range", F.spark_partition_id())
    ordered = materialize(ordered, "mixing")
    # the range in which the budget is reached
    held, last = 0, None
    for r in sorted(ordered.groupBy("range").agg(F.sum("n_tokens").alias("s")).collect()):
        if held + r["s"] > budget:
            last = r["range"]
            break
        held += r["s"]
    if last is None:
        return ordered.drop("range").orderBy(*ORDER)
    within = W.partitionBy("range").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    edge = ordered.filter(F.col("range") == last).withColumn("run", F.sum("n_tokens").over(within) + held).filter(F.col("run") <= budget).drop("run")
    return ordered.filter(F.col("range") < last).unionByName(edge).drop("range").orderBy(*ORDER)


def shares(mixed: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of *targets*: the share reached beside the target, and how
    often it was used on average."""
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    used = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_copies"), F.sum("n_tokens").alias("tokens"), F.max("copy").alias("passes"))
    out = targets.select("source", "target_share", "max_repeats").join(have, "source", "left").join(used, "source", "left").fillna(0, ["available", "n_copies", "tokens", "passes"])
    total = F.sum("tokens").over(W.partitionBy())
    return out.select("source", "target_share", "max_repeats", "available", "n_copies", "tokens", (F.col("tokens") / F.nullif(total, F.lit(0))).alias("share"), (F.col("tokens") / F.nullif("available", F.lit(0))).alias("uses"), "passes")
