"""Queries over versions, and exports, of the given tables.

Versions of the orders: in *ours* every tenth price is one higher and every 97th
order is gone; in *theirs* every 15th has the status X, every 60th a price two
higher, and those with 20 as the rest by 190 are gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloam.cypher.graph import KEY
from graphloam.plans import graphs
from graphloam.session import scratch
from graphloam.sinks.exports import change_report, export_edges as edges_of, export_nodes as nodes_of
from graphloam.sources.tables import table
from graphloam.version.compare import Merged, diff, merge
from graphloam.version.repo import GraphRepo
from graphloam.version.session import RepoSession

ORDER = ["o_orderkey"]
COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = table(spark, sf, "orders").select(*COLUMNS)
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    ours = base.filter(k % 97 != 0).withColumn("o_totalprice", F.when(k % 10 == 0, price + 1).otherwise(price))
    theirs = base.filter(k % 190 != 20).withColumns({"o_totalprice": F.when(k % 60 == 0, price + 2).otherwise(price), "o_orderstatus": F.when(k % 15 == 0, "X").otherwise(F.col("o_orderstatus"))})
    return base, ours, theirs


def diff_nodes(spark: SparkSession, sf: str) -> DataFrame:
    base, ours, _ = versions(spark, sf)
    found = diff(base, ours, ORDER)
    price = lambda side: F.try_element_at(side, F.lit("o_totalprice")).cast("double")
    return found.select("o_orderkey", "change", "properties", price(F.col("before")).alias("price_before"), price(F.col("after")).alias("price_after"))


def diff_edges(spark: SparkSession, sf: str) -> DataFrame:
    """PLACED relationships that differ between the base and *theirs*, by property."""
    base, _, theirs = versions(spark, sf)
    edges = lambda df: df.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_orderstatus").alias("status"))
    found = diff(edges(base), edges(theirs), ["src", "dst"]).select(F.lit("relationship").alias("kind"), F.lit("PLACED").alias("label"), F.concat_ws(">", "src", "dst").alias("key"), "change", "properties", "before", "after")
    return change_report(found)


def _merged(spark: SparkSession, sf: str) -> Merged:
    return merge(*versions(spark, sf), ORDER)


def three_way_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).records.select("o_orderkey", "o_orderstatus", "o_totalprice")


def cell_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Records that both sides changed and that merged property by property."""
    base, ours, theirs = versions(spark, sf)
    both = diff(base, ours, ORDER).filter("change = 'modified'").select("o_orderkey").join(diff(base, theirs, ORDER).filter("change = 'modified'").select("o_orderkey"), "o_orderkey")
    return merge(base, ours, theirs, ORDER).records.join(both, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus", "o_totalprice")


def merge_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    found = _merged(spark, sf).conflicts
    number = lambda c: F.when(F.col("property").isNotNull(), F.col(c).cast("double")).alias(c)
    return found.select("o_orderkey", "property", number("base"), number("ours"), number("theirs"), F.col("ours").isNotNull().alias("in_ours"), F.col("theirs").isNotNull().alias("in_theirs"))


def export_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return nodes_of(graphs.opened("trade", spark, sf), "Customer")


def export_edges(spark: SparkSession, sf: str) -> DataFrame:
    return edges_of(graphs.opened("trade", spark, sf), "PLACED")


def _repo(spark: SparkSession, sf: str) -> GraphRepo:
    """Base and *ours* as two commits of one repository, tagged v1 and v2."""
    base, ours, _ = versions(spark, sf)
    repo = GraphRepo(spark, scratch(spark, "repo"))
    repo.declare_label("Order", ORDER)
    m = repo.workspace
    repo.put_nodes(m, "Order", base)
    repo.save(m)
    repo.commit("base")
    repo.tag("v1")
    changed = diff(base, ours, ORDER)
    m = repo.workspace
    repo.put_nodes(m, "Order", ours.join(changed.filter("change <> 'removed'").select(*ORDER), ORDER, "left_semi"))
    repo.delete_nodes(m, "Order", changed.filter("change = 'removed'").select(F.col("o_orderkey").cast("string").alias(KEY)))
    repo.save(m)
    repo.commit("ours")
    repo.tag("v2")
    return repo


def at_version(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of the first version beside what became of them."""
    s = RepoSession(_repo(spark, sf))
    return s.run("MATCH (o:Order) AT 'v1' WHERE o.o_orderkey % 10 = 0 OPTIONAL MATCH (n:Order) WHERE n.o_orderkey = o.o_orderkey RETURN o.o_orderkey AS k, o.o_totalprice AS was, n.o_totalprice AS now")


def diff_versions(spark: SparkSession, sf: str) -> DataFrame:
    found = _repo(spark, sf).diff("v1", "v2")
    return found.select("kind", "label", F.col("key").cast("bigint").alias("key"), "change")


def call_diff(spark: SparkSession, sf: str) -> DataFrame:
    s = RepoSession(_repo(spark, sf))
    return s.run("CALL diff('v1', 'v2') YIELD kind, label, key WITH kind, label, count(*) AS n RETURN kind, label, n")


def write_set(spark: SparkSession, sf: str) -> DataFrame:
    """Read back after SET, MERGE, CREATE and DELETE."""
    s = RepoSession(_repo(spark, sf))
    s.run("MATCH (o:Order) WHERE o.o_orderstatus = 'F' SET o.o_totalprice = o.o_totalprice * 2, o.doubled = true")
    s.run("UNWIND [-1, 1, -1] AS k MERGE (o:Order {o_orderkey: k}) ON CREATE SET o.o_totalprice = 0.5")
    s.run("MATCH (o:Order) WHERE o.o_orderkey % 7 = 3 DELETE o")
    return s.run("MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS price, o.doubled AS doubled")


QUERIES = {f.__name__: f for f in (diff_nodes, diff_edges, three_way_merge, cell_merge, merge_conflicts, export_nodes, export_edges, at_version, diff_versions, call_diff, write_set)}

_V = """
with b as (select o_orderkey k, o_custkey c, o_orderstatus s, o_totalprice p from orders),
o as (select k, c, s, case when k % 10 = 0 then p + 1 else p end p from b where k % 97 <> 0),
t as (select k, c, case when k % 15 = 0 then 'X' else s end s, case when k % 60 = 0 then p + 2 else p end p from b where k % 190 <> 20),
j as (select b.k, b.s bs, b.p bp, o.s os, o.p op, t.s ts, t.p tp, o.k is not null ho, t.k is not null ht from b left join o using (k) left join t using (k)),
w as (select *, (not ho and ht and (ts <> bs or tp <> bp)) or (ho and not ht and (os <> bs or op <> bp)) whole, ho and ht and op <> bp and tp <> bp and op <> tp clash from j),
m as (select k, case when whole then bs when ho and ht then case when ts <> bs then ts else os end when ho then os else ts end s,
  case when whole then bp when clash then null when ho and ht then case when tp <> bp then tp else op end when ho then op else tp end p, ho, ht, os, bs, op, bp, ts, tp from w where whole or (ho and ht))
"""
ORACLE = {
    "diff_nodes": _V + "select k as o_orderkey, case when ho then 'modified' else 'removed' end as change, case when ho then ['o_totalprice'] else ['o_custkey', 'o_orderpriority', 'o_orderstatus', 'o_totalprice'] end as properties, bp as price_before, op as price_after from j where not ho or op <> bp",
    "diff_edges": _V + "select 'relationship' as kind, 'PLACED' as label, b.c || '>' || b.k as key, case when t.k is null then 'removed' else 'modified' end as change, 'status' as property, b.s as before, t.s as after from b left join t using (k) where t.k is null or t.s <> b.s",
    "three_way_merge": _V + "select k as o_orderkey, s as o_orderstatus, p as o_totalprice from m",
    "cell_merge": _V + "select k as o_orderkey, s as o_orderstatus, p as o_totalprice from m where ho and ht and (os <> bs or op <> bp) and (ts <> bs or tp <> bp)",
    "merge_conflicts": _V + "select k as o_orderkey, case when clash then 'o_totalprice' end as property, case when clash then bp end as base, case when clash then op end as ours, case when clash then tp end as theirs, ho as in_ours, ht as in_theirs from w where whole or clash",
    "export_nodes": "select * from customer",
    "export_edges": "select o_custkey as src, o_orderkey as dst, o_orderdate from orders",
    "at_version": _V + "select b.k, b.p as was, o.p as now from b left join o using (k) where b.k % 10 = 0",
    "diff_versions": _V + "select 'node' as kind, 'Order' as label, k as key, case when ho then 'modified' else 'removed' end as change from j where not ho or op <> bp",
    "call_diff": _V + "select case when ho then 'modified' else 'removed' end as kind, 'Order' as label, count(*) as n from j where not ho or op <> bp group by all",
    "write_set": _V + "select k, case when s = 'F' then p * 2 else p end as price, case when s = 'F' then true end as doubled from o where k % 7 <> 3 union all select -1, 0.5, null",
}
