"""The given tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, types as T

_SCHEMAS: dict[tuple, T.StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table by name.  Its schema is read from the footer once per file, since
    that takes a job of its own each time."""
    path = f"{sf}/{name}.parquet"
    local = path.removeprefix("file://")
    if not os.path.exists(local):
        return spark.read.parquet(path)
    at = os.stat(local)
    key = (spark.sparkContext.applicationId, path, at.st_mtime_ns, at.st_size)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)
