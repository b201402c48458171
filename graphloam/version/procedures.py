"""The procedures that a query can CALL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloam.cypher.graph import KEY, LABELS
from graphloam.cypher.session import Procedure
from graphloam.version.repo import GraphRepo


def procedures(repo: GraphRepo) -> dict[str, Procedure]:
    spark = repo.spark

    def log(ref: str | None = None) -> DataFrame:
        rows = [(x["commit"], x["message"].partition("\n")[0]) for x in repo.log(ref or "HEAD")]
        return spark.createDataFrame(rows, "commit string, subject string")

    def diff(a: str, b: str) -> DataFrame:
        """Changes from *a* to *b*; a node comes as its state in *b* (in *a* if it
        was removed), as JSON, with a label that names the change."""
        found = repo.diff(a, b)
        x, y = repo.manifest(a), repo.manifest(b)
        states = None
        for side, m, gone in (("old", x, True), ("new", y, False)):
            for label, t in m.nodes.items():
                df = repo.table(t)
                props = F.to_json(F.struct(*[F.col(f"`{p}`") for p in sorted(df.columns) if p not in (KEY, LABELS)]))
                labels = F.concat(F.array(F.lit(label)), F.coalesce(F.col(LABELS), F.array().cast("array<string>")))
                part = df.select(F.lit(label).alias("label"), F.col(KEY).alias("key"), F.lit(gone).alias("gone"), F.struct(labels.alias("labels"), props.alias("properties")).alias("n"))
                states = part if states is None else states.unionAll(part)
        changed = found.withColumn("gone", F.col("change") == "removed")
        mark = F.concat(F.lit("_"), F.initcap("change"))
        if states is None:
            return changed.select(F.col("change").alias("kind"), "label", "key", F.lit(None).cast("string").alias("node"))
        joined = changed.withColumn("is_node", F.col("kind") == "node").join(states.withColumn("is_node", F.lit(True)), ["label", "key", "gone", "is_node"], "left")
        node = F.when(F.col("is_node"), F.to_json(F.struct(F.concat(F.array(mark), "n.labels").alias("labels"), F.col("n.properties").alias("properties"))))
        return joined.select(F.col("change").alias("kind"), "label", "key", node.alias("node"))

    def blame(label: str, key) -> DataFrame:
        rows = repo.blame(label, str(key))
        return spark.createDataFrame([(r["label"], r["key"], r["commit"], r["subject"]) for r in rows], "label string, key string, commit string, subject string")

    return {"log": Procedure(0, 1, log), "diff": Procedure(2, 2, diff), "blame": Procedure(2, 2, blame), "conflicts": Procedure(0, 0, repo.conflicts)}
