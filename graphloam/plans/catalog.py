"""All queries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloam.plans import graph_queries, problems, version_queries

MODULES = (problems, graph_queries, version_queries)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return graph_queries.FLAGSHIP.run(spark, sf)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
