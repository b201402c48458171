"""What changed between consecutive full snapshots of a table.

Snapshots are laid out range-partitioned and sorted by key, each range holding
that stretch of keys of every snapshot.  One pass streams a merge over a range:
for each pair of consecutive snapshots two pointers stand at the next key of
either; a key at the old pointer alone was removed, one at the new pointer alone
was added, one at both is compared column by column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

CHANGES = ("added", "removed", "modified")


def _steps(no: str):
    """A streaming merge over batches sorted by (key, snapshot)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the row at the old pointer, where a batch ended
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([last, batch] if last is not None else [batch]).combine_chunks()
            yield from _merge(table, last is not None)
            last = batch.slice(batch.num_rows - 1)
        if last is not None:  # nothing follows: the last key was removed unless it is in the last snapshot
            yield from _merge(pa.Table.from_batches([last]), True, closing=True)

    return merge


def _merge(table: pa.Table, carried: bool, closing: bool = False) -> Iterator[pa.RecordBatch]:
    """Compare each row with the one before it.  A carried first row was
    compared with its forerunner before; the last row waits for its follower."""
    n = table.num_rows
    key, at = table["key"].combine_chunks(), table["at"].to_numpy()
    state = table["state"].combine_chunks()
    same_key = np.zeros(n + 1, bool)  # row i has the key of row i - 1
    same_state = np.zeros(n + 1, bool)
    if n > 1:
        same_key[1:n] = pc.equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        same_state[1:n] = pc.equal(state.slice(1), state.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    follows = same_key.copy()
    follows[1:n] &= at[1:] == at[:-1] + 1
    rows = np.arange(n)
    new = rows[1 if carried else 0 :]
    old = rows if closing else rows[: n - 1]
    added = new[~follows[new] & (at[new] > 0)]
    modified = new[follows[new] & ~same_state[new]]
    removed = old[~follows[old + 1] & (at[old] < table["last"].to_numpy()[old])]
    kinds = np.repeat(np.arange(3), [len(added), len(removed), len(modified)])
    if not len(kinds):
        return
    after = pa.array(np.concatenate([added, removed, modified]))
    none = pa.nulls(len(added) + len(removed), pa.int64())
    before = pa.concat_arrays([none[: len(added)], pa.array(removed, pa.int64()), pa.array(modified - 1, pa.int64())])
    shown = pa.concat_arrays([pa.array(added, pa.int64()), none[: len(removed)], pa.array(modified, pa.int64())])
    position = np.concatenate([at[added], at[removed] + 1, at[modified]])
    yield pa.RecordBatch.from_arrays(
        [key.take(after), pa.array(position.astype("int32")), pa.array(CHANGES).take(pa.array(kinds)), state.take(before), state.take(shown)],
        names=["key", "at", "change", "before", "after"],
    )


def snapshot_changes(
    snapshots: DataFrame,
    key: str,
    number: str,
    columns: list[str],
    *,
    sets: tuple[str, ...] = (),
    delivered: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Typed changes between each snapshot and the one with the next lower number.

    Result: *number* (of the later snapshot), *key*, ``change`` (added, removed,
    modified), ``before`` and ``after`` (the compared *columns* as a struct, null
    where there is none) and ``changed`` (names of the columns that differ).

    Columns compare exactly; null is a value of its own.  Array columns named in
    *sets* compare as sets: order and repetition don't count, a null set is not
    an empty one.  Of several rows of one key in one snapshot the one delivered
    last holds, then the greatest state, so repeated rows vanish.  Rows without
    key or number belong to no record and are left out.  The first snapshot has
    no changes; a snapshot without rows is not seen.  Further columns of any
    name are ignored.  Empty input gives an empty result.
    """
    value = lambda c: F.array_sort(F.array_distinct(F.col(c))) if c in sets else F.col(c)
    state = F.struct(*[value(c).alias(c) for c in columns])
    kind: T.StructType = snapshots.select(state.alias("s")).schema["s"].dataType
    # repeated rows of a key, however many, are reduced before the shuffle
    rows = snapshots.filter(F.col(key).isNotNull() & F.col(number).isNotNull()).select(
        F.col(key).alias("key"), F.col(number).alias("no"), F.to_json(state, {"ignoreNullFields": "false"}).alias("state"), (F.col(delivered) if delivered else F.lit(0)).alias("d")
    )
    latest = F.max(F.struct("d", "state"))
    rows = rows.groupBy("key", "no").agg(latest["state"].alias("state"))
    # one row per snapshot: its place and the last place
    numbers = snapshots.filter(F.col(number).isNotNull() & F.col(key).isNotNull()).select(F.col(number).alias("no")).distinct()
    places = numbers.select("no", (F.row_number().over(W.orderBy("no")) - 1).cast("int").alias("at"), (F.count(F.lit(1)).over(W.partitionBy()) - 1).cast("int").alias("last"))
    laid = rows.join(places, "no").select("key", "at", "state", "last")
    laid = laid.repartitionByRange(*([partitions] if partitions else []), "key").sortWithinPartitions("key", "at")
    key_type = snapshots.schema[key].dataType
    out = T.StructType([T.StructField("key", key_type), T.StructField("at", T.IntegerType()), T.StructField("change", T.StringType()), T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])
    changes = laid.mapInArrow(_steps("no"), out)
    ddl = kind.simpleString()
    before, after = (F.from_json(c, ddl) for c in ("before", "after"))
    changes = changes.join(places.select("no", "at"), "at").select(F.col("no").alias(number), F.col("key").alias(key), "change", before.alias("before"), after.alias("after"))
    differs: list[Column] = [F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)) for c in columns]
    return changes.withColumn("changed", F.when(F.col("change") == "modified", F.array_compact(F.array(*differs))))
