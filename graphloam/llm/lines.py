"""Cross-document line frequency.

Lines that many documents of a host hold (headers, disclaimers, menus) are
removed, and a document of which too little remains is rejected.  A line is
known by a hash of its normal form; hashes are counted by distinct documents
and host, and what lies above the limit goes back to the documents by a join.

The lines of all documents are shuffled once, as two integers each.  A line held
by a third of all documents is counted by partial aggregates; for the way back
its row is repeated under ``SALTS`` salts and each document's lines carry one of
them, so no task gets all holders of one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LIMIT = 4
KEPT_SHARE = 0.5
SALTS = 64


def normal(line: Column) -> Column:
    """Without case, punctuation and the amount of white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}\p{M}]+", " "), " +", " "))


def _name(line: Column) -> Column:
    """128 bits that stand for a line's normal form."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"))


def split_lines(docs: DataFrame, doc_id: str, host: str, text: str) -> DataFrame:
    """``id, host, place, line`` of every line of every text."""
    lines = F.posexplode(F.split(F.regexp_replace(f"`{text}`", "\r\n?", "\n"), "\n")).alias("place", "line")
    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{host}`").alias("host"), lines)


def line_frequency(docs: DataFrame, *, doc_id: str = "doc_id", host: str = "source", text: str = "text", limit: int = LIMIT, kept_share: float = KEPT_SHARE) -> DataFrame:
    """Per document: ``doc_id``, ``n_lines`` (those that are not blank),
    ``n_removed`` (lines that more than *limit* distinct documents of the host
    hold), ``n_chars`` and ``n_kept`` (code points of normal forms, before and
    after) and ``rejected`` (less than *kept_share* of the characters remain).

    Null hosts are one host.  Null, empty and blank texts have no lines and are
    not rejected.  Rows of equal id are one document, however often they
    come, and rows with a null id likewise.  Texts of any length are read
    whole; further columns are ignored.
    """
    each = split_lines(docs, doc_id, host, text).withColumn("norm", normal(F.col("line"))).filter("norm <> ''")
    each = each.select("id", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("none"), "place", _name(F.col("norm")).alias("name"), F.length("norm").alias("chars")).distinct()
    by = ["host", "none", "name"]
    held = each.select(*by, "id").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    held = held.select(*by, F.lit(1).alias("often"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = each.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    marked = salted.join(held, [*by, "salt"], "left")
    found = marked.groupBy("id").agg(F.count(F.lit(1)).alias("n_lines"), F.count("often").alias("n_removed"), F.sum("chars").alias("n_chars"), F.coalesce(F.sum(F.when(F.col("often").isNull(), F.col("chars"))), F.lit(0)).alias("n_kept"))
    every = docs.select(F.col(f"`{doc_id}`").alias("id")).distinct()
    both = every.alias("d").join(found.alias("f"), F.col("d.id").eqNullSafe(F.col("f.id")), "left").select(F.col("d.id").alias("doc_id"), *[F.coalesce(f"f.{x}", F.lit(0).cast("bigint")).alias(x) for x in ("n_lines", "n_removed", "n_chars", "n_kept")])
    return both.withColumn("rejected", (F.col("n_removed") > 0) & (F.col("n_kept") < F.col("n_chars") * kept_share))


def without_frequent_lines(docs: DataFrame, *, doc_id: str = "doc_id", host: str = "source", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, text``: what remains of each text without its frequent lines;
    blank lines stay.  One row per id; a text without any line left is empty, a
    null text stays null."""
    each = split_lines(docs, doc_id, host, text).withColumn("norm", normal(F.col("line")))
    each = each.select("id", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("none"), "place", "line", F.when(F.col("norm") != "", _name(F.col("norm"))).alias("name")).distinct()
    by = ["host", "none", "name"]
    held = each.filter("name is not null").select(*by, "id").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    held = held.select(*by, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rest = each.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(held, [*by, "salt"], "left_anti")
    joined = rest.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("rest"))
    every = docs.groupBy(F.col(f"`{doc_id}`").alias("id")).agg(F.count(f"`{text}`").alias("n"))
    return every.alias("d").join(joined.alias("j"), F.col("d.id").eqNullSafe(F.col("j.id")), "left").select(F.col("d.id").alias("doc_id"), F.when(F.col("d.n") > 0, F.coalesce("j.rest", F.lit(""))).alias("text"))
