"""Ordered work per key when one key may hold a large part of all rows.

A window over ``(key) order by (time)`` puts every row of a key into one task.
Here keys with more rows than a task should get are found first (a pre-aggregated
count), and each of them is cut into buckets along its own time axis.  Their
number is bounded by construction: a key counts as hot only above
``total / MAX_SPLITS`` rows, so all hot keys together have at most
``MAX_SPLITS`` buckets, and what is broadcast or brought to the driver has at
most that many small rows, at any size of the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

MAX_SPLITS = 10_000
ROWS_PER_TASK = 100_000
BUCKET = "__bucket"


@dataclass
class HotKeys:
    """Hot keys and the number of buckets of each (at most MAX_SPLITS rows)."""

    keys: list[str]
    rows: list[tuple]
    schema: T.StructType

    def __bool__(self) -> bool:
        return bool(self.rows)

    def frame(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(self.rows, self.schema)

    def only(self, df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(self.frame(df).select(*self.keys)), self.keys, "left_semi")

    def without(self, df: DataFrame) -> DataFrame:
        """Rows of all other keys; rows with null keys stay."""
        return df.join(F.broadcast(self.frame(df).select(*self.keys)), self.keys, "left_anti") if self.rows else df


def find_hot(counted: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> HotKeys:
    """*counted* has the key columns of every row that will be processed; it is
    read once, for the counts by key and their total.  Fewer than MAX_SPLITS
    keys can be hot, so the greatest MAX_SPLITS counts tell all of them."""
    schema = T.StructType([counted.schema[k] for k in keys] + [T.StructField("buckets", T.IntegerType())])
    sums = Observation()
    per_key = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).observe(sums, F.sum("n").alias("total"))
    found = per_key.filter(F.col("n") > rows_per_task).orderBy(F.desc("n")).limit(MAX_SPLITS).collect()
    if not found:
        return HotKeys(keys, [], schema)
    limit = max(rows_per_task, math.ceil(sums.get["total"] / MAX_SPLITS))
    rows = [(*[r[k] for k in keys], min(MAX_SPLITS, math.ceil(r["n"] / limit))) for r in found if r["n"] > limit and all(r[k] is not None for k in keys)]
    return HotKeys(keys, rows, schema)


def with_buckets(df: DataFrame, hot: HotKeys, order: str) -> DataFrame:
    """Rows of hot keys with a bucket number that rises with *order*; equal
    values of *order* share a bucket.  Split points are approximate quantiles
    of each key's own rows, searched in two levels."""
    spark = df.sparkSession
    # keys of like bucket number share one mergeable aggregate per level (at most 14 levels)
    levels: dict[int, list[tuple]] = {}
    for row in hot.rows:
        levels.setdefault(1 << max(1, math.ceil(math.log2(row[-1]))), []).append(row)
    points: list[tuple] = []
    for n, rows in levels.items():
        own = HotKeys(hot.keys, rows, hot.schema)
        cuts = [i / n for i in range(1, n)]
        got = own.only(df).groupBy(*hot.keys).agg(F.percentile_approx(order, cuts, 10_000).alias("cuts")).collect()
        for r in got:
            cut = sorted(set(r["cuts"] or []))
            step = max(1, math.isqrt(len(cut)))
            fine = [cut[i : i + step] for i in range(0, len(cut), step)]
            points.append((*[r[k] for k in hot.keys], [f[0] for f in fine], fine, step))
    kind = df.schema[order].dataType
    schema = T.StructType([df.schema[k] for k in hot.keys] + [T.StructField("__coarse", T.ArrayType(kind)), T.StructField("__fine", T.ArrayType(T.ArrayType(kind))), T.StructField("__step", T.IntegerType())])
    cuts = F.broadcast(spark.createDataFrame(points, schema))
    value = F.col(order)
    coarse = F.size(F.filter("__coarse", lambda c: c <= value))
    fine = F.size(F.filter(F.get("__fine", F.col("__c") - 1), lambda c: c <= value))
    bucket = F.when(F.col("__c") == 0, 0).otherwise((F.col("__c") - 1) * F.col("__step") + fine)
    return df.join(cuts, hot.keys).withColumn("__c", coarse).withColumn(BUCKET, bucket.cast("int")).drop("__coarse", "__fine", "__step", "__c")


def carried(summary: DataFrame, keys: list[str], value: Column, alias: str, forward: bool = True) -> DataFrame:
    """For every bucket of *summary* (one row per key and bucket) the value
    carried in from the buckets before it (*forward*) or after it.  *value* is
    an aggregate such as ``max``; the table is bounded by MAX_SPLITS rows."""
    from pyspark.sql import Window as W

    order = F.col(BUCKET) if forward else F.col(BUCKET).desc()
    over = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return summary.select(*keys, BUCKET, value.over(over).alias(alias))
