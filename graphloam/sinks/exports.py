"""Nodes and relationships as tables, and tables as files."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F, types as T

from graphloam.cypher.errors import BindError, CypherError
from graphloam.cypher.graph import DST, SRC, Graph, did_you_mean

RESERVED = ("src", "dst")


def export_nodes(graph: Graph, label: str) -> DataFrame:
    """The nodes of a label: its key columns, then all others by name."""
    if label not in graph.nodes:
        raise BindError(f"unknown label {label}" + did_you_mean(label, graph.labels))
    t = graph.nodes[label]
    rest = sorted(set(t.props) - set(t.keys))
    return t.df.select(*[F.col(f"`{x}`") for x in (*t.keys, *rest)])


def export_edges(graph: Graph, rtype: str) -> DataFrame:
    """The relationships of a type: ``src``, ``dst``, the discriminator if there
    is one, then the properties by name.

    Refused: ends with keys of several parts, a type between several pairs of
    labels, and properties that have the name of one of these columns.
    """
    tables = [t for t in graph.rels if t.type == rtype]
    if not tables:
        raise BindError(f"unknown relationship type {rtype}" + did_you_mean(rtype, graph.types))
    if len(tables) > 1:
        raise CypherError(f"{rtype} leads between {len(tables)} pairs of labels; one table can't hold them")
    t = tables[0]
    for label in (t.src_label, t.dst_label):
        if len(graph.nodes[label].keys) > 1:
            raise CypherError(f"the key of {label} has several parts")
    clash = set(t.props) & set(RESERVED)
    if clash:
        raise CypherError(f"{rtype} has properties named {', '.join(sorted(clash))}")
    first = [t.discriminator] if t.discriminator and t.discriminator in t.props else []
    rest = sorted(set(t.props) - set(first))
    return t.df.select(F.col(SRC).alias("src"), F.col(DST).alias("dst"), *[F.col(f"`{x}`") for x in (*first, *rest)])


def _as_text(f: T.StructField) -> Column:
    col = F.col(f"`{f.name}`")
    return F.to_json(col).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else col


def _finite(f: T.StructField) -> Column:
    """JSON has no NaN and no infinity: null stands for them."""
    col = F.col(f"`{f.name}`")
    if not isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return col
    return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col).alias(f.name)


def write(df: DataFrame, path: str, format: str) -> None:
    """CSV (with header, lists as JSON texts), JSON lines (absent values left
    out) or Parquet, as a folder of files."""
    if format == "csv":
        df.select(*[_as_text(f) for f in df.schema.fields]).write.option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)
    elif format in ("json", "ndjson"):
        df.select(*[_finite(f) for f in df.schema.fields]).write.option("ignoreNullFields", True).json(path)
    elif format == "parquet":
        df.write.parquet(path)
    else:
        raise BindError(f"unknown format {format}" + did_you_mean(format, ["csv", "json", "ndjson", "parquet"]))


def render(df: DataFrame, format: str) -> Iterator[str]:
    """A result line by line, as ``table``, ``json`` or ``csv``; rows come through
    an iterator, a partition at a time."""
    if format == "json":
        whole = F.to_json(F.struct(*[_finite(f).alias(f.name) for f in df.schema.fields]), {"ignoreNullFields": "false"})
        yield from (r[0] for r in df.select(whole).toLocalIterator())
        return
    if format not in ("csv", "table"):
        raise BindError(f"unknown format {format}" + did_you_mean(format, ["table", "json", "csv"]))
    texts = df.select(*[_as_text(f).cast("string").alias(f.name) for f in df.schema.fields])

    def line(cells) -> str:
        if format == "table":
            return " | ".join("null" if x is None else x for x in cells)
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(["" if x is None else x for x in cells])
        return out.getvalue()

    yield line(df.columns)
    for row in texts.toLocalIterator():
        yield line(row)


def change_report(changes: DataFrame) -> DataFrame:
    """Changes of ``GraphRepo.diff`` property by property: ``kind, label, key,
    change, property, before, after``."""
    one = F.explode_outer("properties").alias("property")
    return changes.select("kind", "label", "key", "change", one, "before", "after").select(
        "kind", "label", "key", "change", "property", F.try_element_at("before", F.col("property")).alias("before"), F.try_element_at("after", F.col("property")).alias("after")
    )


def report_lines(changes: DataFrame, conflicts: DataFrame | None = None, format: str = "markdown") -> DataFrame:
    """A report as ``place, line`` in order: JSON lines, or a table in markdown."""
    rows = change_report(changes).select("*", F.lit("change").alias("what"))
    if conflicts is not None:
        rows = rows.unionByName(conflicts.select("kind", "label", "key", "property", F.col("base").alias("before"), F.concat_ws(" / ", F.coalesce("ours", F.lit("-")), F.coalesce("theirs", F.lit("-"))).alias("after"), F.lit("conflict").alias("what"), F.lit("conflict").alias("change")))
    order = F.struct(F.col("what"), F.col("kind"), F.col("label"), F.col("key"), F.col("property"))
    if format == "json":
        line = F.to_json(F.struct("what", "kind", "label", "key", "change", "property", "before", "after"))
    else:
        cell = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"([|\\])", r"\\$1")
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(x)) for x in ("kind", "label", "key", "change", "property", "before", "after")]), F.lit(" |"))
    out = rows.select(order.alias("place"), line.alias("line"))
    if format == "markdown":
        head = json.dumps(["| kind | label | key | change | property | before | after |", "|---|---|---|---|---|---|---|"])
        first = rows.sparkSession.range(1).select(F.posexplode(F.from_json(F.lit(head), "array<string>")).alias("i", "line"))
        blank = F.struct(F.lit("").alias("what"), F.col("i").cast("string").alias("kind"), F.lit("").alias("label"), F.lit("").alias("key"), F.lit("").alias("property"))
        out = out.unionByName(first.select(blank.alias("place"), "line"))
    return out.orderBy("place")
