"""History of changing attributes, with the period each version was valid.

Input are whole states per entity and commit, in any order of arrival, repeated
or late.  They become a change log of single attributes: an event for every
attribute that takes another value or ends at a commit, and existence is an
attribute too.  From the log every attribute has intervals of its own.  Their
begins and ends together cut the time of an entity; a cut at which the set of
values that ends is the set that begins is no change and is coalesced, every
other one begins a version or ends the last.

Shape of the work: one shuffle by entity; log, intervals and cuts reuse that
partitioning, and the cuts are counted in hash aggregates.
An entity with more rows than a task should hold is cut into buckets of time;
each bucket also gets the commit before it, which is all that the log needs to
be exact at a bucket's edge, and an interval that leaves its bucket gets its end
from the first event of its attribute in a later one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloam.operators.hotkeys import BUCKET, ROWS_PER_TASK, find_hot, with_buckets
from graphloam.session import materialize


def pack_id(col: Column) -> Column:
    """Ids of hex digits take half the bytes in shuffles; others stay as they are."""
    return F.when(col.rlike("^([0-9a-f]{2})+$"), F.concat(F.lit(b"\x00"), F.unhex(col))).otherwise(F.concat(F.lit(b"\x01"), F.encode(col, "UTF-8")))


def unpack_id(col: Column) -> Column:
    body = F.substring(col, 2, 2**31 - 1)
    return F.when(F.substring(col, 1, 1) == F.lit(b"\x00"), F.lower(F.hex(body))).otherwise(F.decode(body, "UTF-8"))


STATE = "array<string>"
EVENT = "array<struct<key:string,value:string>>"


def _entries(props: Column) -> Column:
    """Present properties (null values count as absent) as texts that begin with
    the length of the name, in order; in shuffles these take half of what
    structs take."""
    text = lambda e: F.concat(F.length(e["key"]).cast("string"), F.lit(":"), e["key"], e["value"])
    return F.coalesce(F.array_sort(F.transform(F.filter(F.map_entries(props), lambda e: e["value"].isNotNull()), text)), F.array().cast(STATE))


def _parts(entry: Column) -> tuple[Column, Column]:
    """Name and value of an entry."""
    n = F.substring_index(entry, ":", 1)
    at = F.length(n) + 2
    return F.substring(entry, at, n.cast("int")), F.substring(entry, at + n.cast("int"), F.length(entry))


def _timeline(rows: DataFrame, part: list[str]) -> DataFrame:
    """One row per entity and commit with its state (null: deleted) and the
    state before (``was``).

    Several rows of one entity in one commit: the one that arrived last holds
    (then a put, then the greater entries), so redelivered rows vanish.
    """
    last = W.partitionBy(*part, "at").orderBy(F.col("arrived").desc_nulls_last(), F.col("state").desc_nulls_last())
    one = rows.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n", "arrived")
    return one.withColumn("was", F.lag("state").over(W.partitionBy(*part).orderBy("at")))


def _log(timeline: DataFrame, part: list[str], with_state: bool) -> DataFrame:
    """The change log: a row for each attribute that takes another value at a
    commit (null: it ends).  The attribute without a name is existence.  *with_state*
    adds the whole state to one event of each commit."""
    now, was = (F.coalesce(x, F.array().cast(STATE)) for x in ("state", "was"))
    none = F.lit(None).cast("string")
    event = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    names = lambda x: F.transform(x, lambda e: _parts(e)[0])
    timeline = timeline.withColumns({"new": F.array_except(now, was), "old": F.array_except(was, now)})
    begun = F.transform("new", lambda e: event(*_parts(e)))
    ended = F.transform(F.array_except(names(F.col("old")), names(F.col("new"))), lambda k: event(k, none))
    exists = F.when(F.col("state").isNull() != F.col("was").isNull(), F.array(event(none, F.when(F.col("state").isNotNull(), "")))).otherwise(F.array().cast(EVENT))
    events = F.posexplode(F.concat(exists, begun, ended)).alias("i", "e")
    kept = [*part, "at", "commit", *(["own"] if "own" in timeline.columns else [])]
    log = timeline.select(*kept, *(["state"] if with_state else []), events)
    state = [F.when((F.col("i") == 0) & F.col("state").isNotNull(), F.struct("state")).alias("state")] if with_state else []
    return log.select(*kept, F.col("e.key").alias("attr"), F.col("e.value").alias("value"), *state)


def _intervals(log: DataFrame, keys: list[str], bucketed: bool = False) -> DataFrame:
    """Each event of the log with the next one of its attribute (``next``): the
    interval over which the attribute has the value."""
    of_event = F.struct("at", "commit", *[x for x in (BUCKET, "state") if x in log.columns])
    part = [*keys, "attr", *([BUCKET] if bucketed else [])]
    found = log.withColumn("next", F.lead(of_event).over(W.partitionBy(*part).orderBy("at")))
    if not bucketed:
        return found
    # what an attribute's last interval of a bucket lacks is its first event in a later bucket
    heads = log.groupBy(*part).agg(F.min_by(of_event, "at").alias("head"))
    coming = heads.select(*part, F.lead("head").over(W.partitionBy(*keys, "attr").orderBy(BUCKET)).alias("coming")).filter("coming is not null")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in part]
    joined = found.alias("a").join(coming.alias("b"), same, "left")
    return joined.select(*[F.col(f"a.{x}").alias(x) for x in log.columns], F.coalesce("a.next", "b.coming").alias("next"))


def _cuts(intervals: DataFrame, part: list[str]) -> DataFrame:
    """The union of the intervals' begins and ends, coalesced: a cut stays if
    some value begins that does not also end there, or the other way round.
    ``alive`` tells whether the entity exists from the cut on."""
    with_state = "state" in intervals.columns
    extra = lambda of: [F.col(f"{of}state").alias("state")] if with_state else []
    begin = F.struct(F.col("at"), F.col("commit"), F.lit(1).alias("sign"), *[F.col(x) for x in part if x == BUCKET], *extra(""))
    end = F.struct(F.col("next.at").alias("at"), F.col("next.commit").alias("commit"), F.lit(-1).alias("sign"), *[F.col(f"next.{x}").alias(x) for x in part if x == BUCKET], *extra("next."))
    points = intervals.filter("value is not null").select(*[x for x in part if x != BUCKET], "attr", "value", F.explode(F.filter(F.array(begin, end), lambda p: p["at"].isNotNull())).alias("p"))
    points = points.select(*[x for x in part if x != BUCKET], "attr", "value", "p.*")
    state = [F.max("state").alias("state")] if with_state else []
    net = points.groupBy(*part, "at", "commit", "attr", "value").agg(F.sum("sign").alias("net"), *state)
    existence = F.when(F.col("attr").isNull(), F.col("net"))
    cuts = net.groupBy(*part, "at", "commit").agg(F.max(F.col("net") != 0).alias("cut"), F.coalesce(F.min(existence) >= 0, F.lit(True)).alias("alive"), *state)
    return cuts.filter("cut").drop("cut")


def history(
    states: DataFrame,
    commits: DataFrame,
    keys: list[str],
    *,
    commit: str = "commit_id",
    op: str = "op",
    properties: str = "properties",
    arrived: str | None = "arrived_at",
    commit_id: str = "id",
    committed_at: str = "committed_at",
    with_properties: bool = True,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Every version of every entity.

    *states* has the key columns, the commit that wrote the state, an
    operation (``put`` or ``delete``) and the whole state as a map of strings;
    *commits* orders the commits.  Result: the keys, ``properties``,
    ``valid_from``, ``valid_from_id``, ``valid_to`` (null: still valid) and
    ``valid_to_id`` ('' then).  Further columns of the inputs are ignored, and
    without *with_properties* the result has none.

    Null values count as absent, a null or empty map is a state without
    properties, an empty text is a value.  Rows with a null key, commit or
    operation, rows whose commit is not in *commits* and commits without a time
    have no place in the order and give no version (``unplaced`` lists them).
    Commits repeated with other times hold their earliest one.  Null key parts
    are no entity.  Empty inputs give an empty result.
    """
    rows, hot = _rows(states, commits, keys, commit, op, properties, arrived, commit_id, committed_at, rows_per_task)
    log = _log(_timeline(rows(False).repartition(*keys), keys), keys, with_properties)
    found = _between(_cuts(_intervals(log, keys), keys), keys)
    if hot:
        found = found.unionByName(_hot_versions(_hot_log(rows(True), hot, keys, with_properties), keys).select(*found.columns))
    pairs = F.transform(F.coalesce("state.state", F.array().cast(STATE)), lambda e: F.struct(*[x.alias(n) for x, n in zip(_parts(e), ("key", "value"))]))
    whole = F.map_from_entries(pairs).alias("properties")
    return found.filter("alive").select(
        *keys,
        *([whole] if with_properties else []),
        F.col("at").alias("valid_from"),
        unpack_id(F.col("commit")).alias("valid_from_id"),
        F.col("next.at").alias("valid_to"),
        F.coalesce(unpack_id(F.col("next.commit")), F.lit("")).alias("valid_to_id"),
    )


def _rows(states, commits, keys, commit, op, properties, arrived, commit_id, committed_at, rows_per_task):
    """The rows that have a place in the order, of hot or of other entities."""
    log = commits.select(pack_id(F.col(commit_id)).alias("commit"), F.col(committed_at).alias("at")).filter("commit is not null and at is not null").groupBy("commit").agg(F.min("at").alias("at"))
    placed = states.filter(" and ".join(f"`{k}` is not null" for k in [*keys, commit, op]))
    hot = find_hot(placed.select(*keys), keys, rows_per_task)
    when = F.col(arrived) if arrived else F.lit(None).cast("timestamp")
    cols = [pack_id(F.col(commit)).alias("commit"), F.when(F.col(op) == "put", _entries(F.col(properties))).alias("state"), when.alias("arrived")]

    def rows(of_hot: bool) -> DataFrame:
        return (hot.only(placed) if of_hot else hot.without(placed)).select(*keys, *cols).join(log, "commit")

    return rows, hot


def _between(cuts: DataFrame, part: list[str]) -> DataFrame:
    """Each cut with the one after it."""
    return cuts.withColumn("next", F.lead(F.struct("at", "commit")).over(W.partitionBy(*part).orderBy("at")))


def _hot_log(rows: DataFrame, hot, keys: list[str], with_state: bool) -> DataFrame:
    """The change log of hot entities, by bucket of time."""
    part = [*keys, BUCKET]
    rows = materialize(with_buckets(rows, hot, "at").repartition(*part), "history-hot")
    # the last commit before a bucket comes along; equal times share a bucket, so the time decides
    # which rows these are (repeated deliveries of one commit too)
    span = rows.groupBy(*part).agg(F.max("at").alias("hi"))
    need = span.select(*keys, F.col(BUCKET).alias("__to"), F.lag("hi").over(W.partitionBy(*keys).orderBy(BUCKET)).alias("at")).filter("at is not null")
    halo = rows.drop(BUCKET).join(F.broadcast(need), [*keys, "at"]).withColumnRenamed("__to", BUCKET).withColumn("own", F.lit(False))
    both = rows.withColumn("own", F.lit(True)).unionByName(halo).repartition(*part)
    return materialize(_log(_timeline(both, part), part, with_state).filter("own").drop("own"), "history-log")


def _hot_versions(log: DataFrame, keys: list[str]) -> DataFrame:
    part = [*keys, BUCKET]
    cuts = materialize(_cuts(_intervals(log, keys, bucketed=True), part), "history-cuts")
    # the cut after a bucket's last one is the first of a later bucket
    head = cuts.groupBy(*part).agg(F.min_by(F.struct("at", "commit"), "at").alias("head"))
    coming = head.select(*part, F.lead("head").over(W.partitionBy(*keys).orderBy(BUCKET)).alias("coming"))
    both = _between(cuts, part).join(F.broadcast(coming), part, "left")
    return both.withColumn("next", F.coalesce("next", "coming")).drop("coming")


def attribute_log(
    states: DataFrame,
    commits: DataFrame,
    keys: list[str],
    *,
    commit: str = "commit_id",
    op: str = "op",
    properties: str = "properties",
    arrived: str | None = "arrived_at",
    commit_id: str = "id",
    committed_at: str = "committed_at",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Every attribute's own intervals: ``attr, value, valid_from, valid_to``
    for each stretch over which it has one value (attr null: the entity exists)."""
    rows, hot = _rows(states, commits, keys, commit, op, properties, arrived, commit_id, committed_at, rows_per_task)
    out = [*keys, "attr", "value", F.col("at").alias("valid_from"), F.col("next.at").alias("valid_to")]
    found = _intervals(_log(_timeline(rows(False).repartition(*keys), keys), keys, False), keys).filter("value is not null").select(*out)
    if hot:
        found = found.unionByName(_intervals(_hot_log(rows(True), hot, keys, False), keys, bucketed=True).filter("value is not null").select(*out))
    return found


def as_of(versions: DataFrame, at: Column) -> DataFrame:
    """The versions valid at a time."""
    return versions.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def unplaced(states: DataFrame, commits: DataFrame, keys: list[str], commit: str = "commit_id", commit_id: str = "id", committed_at: str = "committed_at") -> DataFrame:
    """Rows that ``history`` can't place in the order of commits."""
    placed = commits.filter(F.col(commit_id).isNotNull() & F.col(committed_at).isNotNull()).select(F.col(commit_id).alias(commit)).distinct()
    known = states.filter(" and ".join(f"`{k}` is not null" for k in keys)).join(placed, commit, "left_anti")
    return known.unionByName(states.filter(" or ".join(f"`{k}` is null" for k in keys)))
