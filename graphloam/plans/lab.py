"""An asset registry of any scale, drawn by hash, with the published queries.

Of scale n: n hosts, n / 5 packages, n / 250 suppliers, n certificates.  A host
runs up to three packages and has one certificate, a package has one supplier and
depends on one earlier package; the last twentieth of the packages runs nowhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloam.cypher.graph import DST, EID, KEY, SRC, Graph, NodeTable, RelTable

#: The five queries of the published benchmark, as published.
PUBLISHED = {
    "certificate_sweep": "MATCH (h:Host)-[:HAS_CERT]->(c:Certificate) WHERE c.not_after < 30 AND NOT h.decommissioned RETURN h, c.cn, c.not_after ORDER BY c.not_after LIMIT 100",
    "orphaned_software": "MATCH (s:Software) WHERE NOT (s)<-[:RUNS]-(:Host) RETURN s.name ORDER BY s.name",
    "blast_radius": "MATCH (v:Supplier {name: 'supplier-0'})<-[:SUPPLIED_BY]-(s:Software) OPTIONAL MATCH (s)<-[:DEPENDS_ON*0..3]-(top:Software)<-[:RUNS]-(h:Host) RETURN count(DISTINCT h) AS exposed_hosts",
    "hosts_by_os": "MATCH (h:Host {os: 'debian'}) RETURN count(*) AS debian_hosts",
    "critical_hosts": "MATCH (h:Host)-[:RUNS]->(s:Software)-[:SUPPLIED_BY]->(v:Supplier) WHERE v.country = 'DE' AND h.criticality >= 3 RETURN count(DISTINCT h) AS n",
}
#: Systems and countries.
SYSTEMS = ("debian", "ubuntu", "rhel", "windows", "freebsd")
COUNTRIES = ("DE", "US", "GB", "FR", "NL", "JP")


def _pick(names: tuple[str, ...]):
    return F.get(F.array(*[F.lit(x) for x in names]), (F.col("id") % len(names)).cast("int"))


def _drawn(what: str, below):
    """A number under *below* by hash of the row's number."""
    return F.pmod(F.xxhash64(F.lit(what), "id"), below)


def generate(spark: SparkSession, n: int) -> dict[str, DataFrame]:
    software, suppliers = max(n // 5, 2), max(n // 250, 1)
    used = software - max(software // 20, 1)
    name = lambda kind, x: F.concat(F.lit(f"{kind}-"), x.cast("string"))
    i = F.col("id")
    own = lambda kind: name(kind, i).alias(KEY)
    rel = lambda a, b: [a.alias(SRC), b.alias(DST), F.concat_ws(">", a, b).alias(EID)]
    runs = spark.range(n).select("id", F.explode(F.array_distinct(F.array(*[_drawn(f"run {k}", F.lit(used)) for k in range(3)]))).alias("p"))
    return {
        "Host": spark.range(n).select(own("host"), name("host", i).alias("hostname"), _pick(SYSTEMS).alias("os"), (i % 7).alias("criticality"), (i % 17 == 0).alias("decommissioned")),
        "Software": spark.range(software).select(own("pkg"), name("pkg", i).alias("name"), F.concat_ws(".", i % 9, i % 7).alias("version"), (100 + i % 9000).alias("size_kb")),
        "Supplier": spark.range(suppliers).select(own("supplier"), name("supplier", i).alias("name"), _pick(COUNTRIES).alias("country")),
        "Certificate": spark.range(n).select(own("cert"), name("cert", i).alias("serial"), F.concat(F.lit("cn-"), i).alias("cn"), (i % 365).alias("not_after")),
        "RUNS": runs.select(*rel(name("host", i), name("pkg", F.col("p")))),
        "HAS_CERT": spark.range(n).select(*rel(name("host", i), name("cert", i))),
        "SUPPLIED_BY": spark.range(software).select(*rel(name("pkg", i), name("supplier", i % suppliers))),
        "DEPENDS_ON": spark.range(1, software).select(*rel(name("pkg", i), name("pkg", _drawn("need", i)))),
    }


def lab(frames: dict[str, DataFrame]) -> Graph:
    keys = {"Host": "hostname", "Software": "name", "Supplier": "name", "Certificate": "serial"}
    ends = {"RUNS": ("Host", "Software"), "HAS_CERT": ("Host", "Certificate"), "SUPPLIED_BY": ("Software", "Supplier"), "DEPENDS_ON": ("Software", "Software")}
    spark = frames["Host"].sparkSession
    return Graph(spark, {k: NodeTable(k, frames[k], (v,)) for k, v in keys.items()}, [RelTable(t, a, b, frames[t]) for t, (a, b) in ends.items()])
