"""The given tables as property graphs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloam.cypher.graph import DST, EID, KEY, LABELS, SRC, Graph, NodeTable, RelTable
from graphloam.sources.tables import table


_OPEN: dict[tuple, Graph] = {}


def opened(name: str, spark: SparkSession, sf: str) -> Graph:
    """A graph by name, put together once per session while its files stay as they are."""
    local = sf.removeprefix("file://")
    if not os.path.isdir(local):
        return BY_NAME[name](spark, sf)
    stats = tuple(sorted((f.name, f.stat().st_mtime_ns, f.stat().st_size) for f in os.scandir(local)))
    key = (spark.sparkContext.applicationId, name, sf, stats)
    if key not in _OPEN:
        _OPEN[key] = BY_NAME[name](spark, sf)
    return _OPEN[key]


def keyed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(KEY, F.col(key).cast("bigint"))


def edges(df: DataFrame, src: str, dst: str, eid: str, *props: str) -> DataFrame:
    return df.select(F.col(src).cast("bigint").alias(SRC), F.col(dst).cast("bigint").alias(DST), F.col(eid).alias(EID), *props)


def trade(spark: SparkSession, sf: str) -> Graph:
    """Customers, orders, parts and suppliers.

    Lines of an order are parallel edges without a unique number; their identity
    is their place in the stored table, which costs neither a shuffle nor a hash
    and is read only by queries that compare edges.
    """
    t = lambda n: table(spark, sf, n)
    nodes = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Order": ("orders", "o_orderkey"), "Event": ("events", "event_id")}
    tables = {label: NodeTable(label, keyed(t(name), key), (key,)) for label, (name, key) in nodes.items()}
    lines = t("lineitem")
    lines = lines.withColumn(EID, F.concat_ws("#", "_metadata.file_path", "_metadata.row_index"))
    props = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    ring = t("nation").select(F.col("n_nationkey").cast("bigint").alias(SRC), ((F.col("n_nationkey") + 1) % 25).cast("bigint").alias(DST), F.col("n_nationkey").cast("bigint").alias(EID))
    rels = [
        RelTable("IN_REGION", "Nation", "Region", edges(t("nation"), "n_nationkey", "n_regionkey", "n_nationkey"), once=("src",)),
        RelTable("LIVES_IN", "Customer", "Nation", edges(t("customer"), "c_custkey", "c_nationkey", "c_custkey"), once=("src",)),
        RelTable("BASED_IN", "Supplier", "Nation", edges(t("supplier"), "s_suppkey", "s_nationkey", "s_suppkey"), once=("src",)),
        RelTable("PLACED", "Customer", "Order", edges(t("orders"), "o_custkey", "o_orderkey", "o_orderkey", "o_orderdate"), once=("dst",)),
        RelTable("CONTAINS", "Order", "Part", edges(lines, "l_orderkey", "l_partkey", EID, *props)),
        RelTable("SHIPPED_BY", "Order", "Supplier", edges(lines, "l_orderkey", "l_suppkey", EID, *props)),
        RelTable("DID", "Customer", "Event", edges(t("events"), "user_id", "event_id", "event_id"), once=("dst",)),
        RelTable("RING", "Nation", "Nation", ring, once=("src", "dst")),
    ]
    return Graph(spark, tables, rels)


#: The properties of each label of the registry and their types.
REGISTRY = {
    "Host": {"os": "string", "criticality": "bigint", "decommissioned": "boolean", "rack": "string"},
    "Software": {"version": "string", "size_kb": "bigint", "licence": "string", "channel": "string"},
    "Supplier": {"country": "string", "tier": "string", "rating": "bigint", "queue": "string"},
    "Certificate": {"cn": "string", "not_after": "bigint", "issuer": "string", "alg": "string"},
}
REGISTRY_KEYS = {"Host": "hostname", "Software": "name", "Supplier": "name", "Certificate": "serial"}


def registry(spark: SparkSession, sf: str) -> Graph:
    """Hosts, software, suppliers and certificates in their latest state, the
    edges between them, and commits with their parents."""
    log = table(spark, sf, "log_entry")
    placed = log.groupBy("id").agg(F.min("committed_at").alias("at"))
    states = table(spark, sf, "node_record").join(placed, F.col("commit_id") == F.col("id"))
    latest = states.groupBy("label", "node_key").agg(F.max_by(F.struct("op", "properties", "secondary_labels"), F.struct("at", "arrived_at")).alias("s"))
    live = latest.filter("s.op = 'put'")
    nodes = {}
    for label, props in REGISTRY.items():
        cols = [F.col("s.properties").getItem(k).try_cast(t).alias(k) for k, t in props.items()]
        second = F.array_sort(F.array_distinct(F.coalesce("s.secondary_labels", F.array().cast("array<string>"))), lambda a, b: F.coalesce(F.nullif(F.octet_length(a) - F.octet_length(b), F.lit(0)), F.when(a < b, -1).when(a > b, 1).otherwise(0)))
        nodes[label] = NodeTable(label, live.filter(F.col("label") == label).select(F.col("node_key").alias(KEY), F.col("node_key").alias(REGISTRY_KEYS[label]), *cols, second.alias(LABELS)), (REGISTRY_KEYS[label],))
    commits = log.groupBy("id").agg(F.min("committed_at").alias("committed_at"), F.min("message").alias("message"))
    nodes["Commit"] = NodeTable("Commit", commits.select(F.col("id").alias(KEY), "*"), ("id",))
    stored = table(spark, sf, "edge_record").dropDuplicates(["edge_id"])
    ends = {"RUNS": ("Host", "Software"), "HAS_CERT": ("Host", "Certificate"), "SUPPLIED_BY": ("Software", "Supplier"), "DEPENDS_ON": ("Software", "Software")}
    rels = []
    for rtype, (a, b) in ends.items():
        own = stored.filter((F.col("rtype") == rtype) & (F.col("src_label") == a) & (F.col("dst_label") == b)).select(F.col("src_key").alias(SRC), F.col("dst_key").alias(DST), F.col("edge_id").alias(EID), "discriminator", F.col("properties")["port"].try_cast("bigint").alias("port"))
        for end, label in ((SRC, a), (DST, b)):
            own = own.join(nodes[label].df.select(F.col(KEY).alias(end)), end, "left_semi")
        rels.append(RelTable(rtype, a, b, own, "discriminator"))
    parents = log.groupBy("id").agg(F.first("parents").alias("p")).select(F.col("id").alias(SRC), F.explode("p").alias(DST)).distinct()
    rels.append(RelTable("PARENT", "Commit", "Commit", parents.select(SRC, DST, F.concat_ws(">", SRC, DST).alias(EID))))
    return Graph(spark, nodes, rels)


BY_NAME = {"trade": trade, "registry": registry}
