"""Immutable keyed tables in buckets.

A table is a set of buckets, chosen by a hash of the key; a bucket is a folder
of Parquet files sorted by key, with the number and a hash of its rows.  A change
rewrites the buckets it touches and shares all others with the version before,
and a comparison of two versions reads the buckets whose hashes differ.

The hash of a bucket is a sum over its rows, so the hash of a table, the sum over
its buckets, depends on the contents alone: not on the order of changes, nor on
the number of buckets, nor on columns that hold nothing but nulls.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from graphloam.version.files import Files

ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 4096
BUCKET = "_b"
WHOLE = "decimal(38,0)"


@dataclass(frozen=True)
class Table:
    """``buckets``: number of the bucket to (folder, rows, sum of hashes, sum of second hashes)."""

    keys: tuple[str, ...]
    schema: str  # of Spark, as JSON
    n: int
    buckets: tuple[tuple[int, tuple[str, int, int, int]], ...] = ()

    @property
    def rows(self) -> int:
        return sum(b[1] for _, b in self.buckets)

    @property
    def hash(self) -> str:
        a, b = (sum(x[i] for _, x in self.buckets) for i in (2, 3))
        return hashlib.sha256(f"{self.rows} {a} {b}".encode()).hexdigest()

    @property
    def type(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))

    def to_json(self) -> dict:
        return {"keys": list(self.keys), "schema": self.schema, "n": self.n, "buckets": {str(k): list(v) for k, v in self.buckets}}

    @staticmethod
    def from_json(d: dict) -> Table:
        return Table(tuple(d["keys"]), d["schema"], d["n"], tuple(sorted((int(k), tuple(v)) for k, v in d["buckets"].items())))


def row_text(columns: list[str]) -> Column:
    """A row as text, by name, without nulls."""
    return F.to_json(F.struct(*[F.col(f"`{x}`") for x in sorted(columns)]), {"ignoreNullFields": "true"})


def bucket_of(keys: tuple[str, ...], n: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in keys]), F.lit(n)).cast("int")


def _sums(columns: list[str]) -> list[Column]:
    text = row_text(columns)
    return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(text).cast(WHOLE)).alias("a"), F.sum(F.xxhash64(F.lit("second"), text).cast(WHOLE)).alias("b")]


class TableStore:
    def __init__(self, spark: SparkSession, files: Files, rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
        self.spark, self.files, self.rows_per_bucket = spark, files, rows_per_bucket

    def read(self, t: Table, only: set[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets."""
        paths = [self.files.path(b[0]) for i, b in t.buckets if only is None or i in only]
        if not paths:
            return self.spark.createDataFrame([], t.type)
        return self.spark.read.schema(t.type).option("recursiveFileLookup", "true").parquet(*paths)

    def _write(self, df: DataFrame, keys: tuple[str, ...], n: int) -> tuple[str, dict[int, tuple]]:
        folder = f"data/{uuid.uuid4().hex}"
        cols = df.columns
        df.withColumn(BUCKET, bucket_of(keys, n)).repartition(n, BUCKET).sortWithinPartitions(BUCKET, *[f"`{k}`" for k in keys]).write.partitionBy(BUCKET).option("compression", "zstd").parquet(self.files.path(folder))
        if not any(x.startswith(f"{BUCKET}=") for x in self.files.list(folder)):
            self.files.delete(folder)
            return folder, {}
        back = self.spark.read.schema(T.StructType([*df.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(self.files.path(folder))
        sums = back.groupBy(BUCKET).agg(*_sums(cols)).collect()
        return folder, {r[BUCKET]: (f"{folder}/{BUCKET}={r[BUCKET]}", r["n"], int(r["a"]), int(r["b"])) for r in sums}

    def hash(self, df: DataFrame, keys: tuple[str, ...]) -> str:
        """The hash that a table of these rows has."""
        r = df.agg(*_sums(df.columns)).head()
        return Table(keys, "", 1, ((0, ("", r["n"], int(r["a"] or 0), int(r["b"] or 0))),)).hash

    def load(self, df: DataFrame, keys: tuple[str, ...], rows: int | None = None) -> Table:
        """A table of all rows of *df*, whose keys are unique."""
        rows = df.count() if rows is None else rows
        n = min(MAX_BUCKETS, 1 << max(0, rows // self.rows_per_bucket).bit_length())
        _, buckets = self._write(df, keys, n)
        return Table(keys, df.schema.json(), n, tuple(sorted(buckets.items())))

    def apply(self, t: Table, puts: DataFrame | None = None, deletes: DataFrame | None = None) -> Table:
        """The table with rows put (in the place of those of the same key) and
        keys deleted.  Columns that are new widen the table.  Only buckets with a
        changed key are read and written; a table that outgrew its number of
        buckets is laid out anew."""
        keys = list(t.keys)
        changed = [x.select(*keys) for x in (puts, deletes) if x is not None]
        if not changed:
            return t
        touched_keys = changed[0] if len(changed) == 1 else changed[0].unionByName(changed[1])
        touched_keys = touched_keys.distinct()
        touched = {r[0] for r in touched_keys.select(bucket_of(t.keys, t.n)).distinct().collect()}
        if not touched:
            return t
        rest = self.read(t, touched).join(touched_keys, keys, "left_anti")
        new = rest if puts is None else rest.unionByName(puts, allowMissingColumns=True)
        folder, buckets = self._write(new, t.keys, t.n)
        # a bucket that came out as it was keeps its folder
        old = dict(t.buckets)
        kept = {i: old[i] if i in old and old[i][1:] == b[1:] else b for i, b in buckets.items()}
        result = Table(t.keys, new.schema.json(), t.n, tuple(sorted({**{i: b for i, b in old.items() if i not in touched}, **kept}.items())))
        if result.rows > 4 * self.rows_per_bucket * t.n and t.n < MAX_BUCKETS:
            return self.load(self.read(result), t.keys, result.rows)
        return result

    def differing(self, a: Table | None, b: Table | None) -> tuple[DataFrame, DataFrame]:
        """The rows of both tables in buckets that may differ."""
        some = b or a
        empty = self.spark.createDataFrame([], some.type)
        if a is None or b is None or a.n != b.n:
            if a is not None and b is not None and a.hash == b.hash:
                return self.read(a, set()), self.read(b, set())
            return (empty if a is None else self.read(a)), (empty if b is None else self.read(b))
        x, y = ({i: v[1:] for i, v in t.buckets} for t in (a, b))
        changed = {i for i in {*x, *y} if x.get(i) != y.get(i)}
        return self.read(a, changed), self.read(b, changed)
