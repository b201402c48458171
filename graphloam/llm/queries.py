"""Queries for the problems 6 to 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloam.llm.bpe import count_tokens, encode
from graphloam.llm.lines import line_frequency
from graphloam.llm.mixing import mixture, shares
from graphloam.llm.repetition import measure
from graphloam.session import materialize
from graphloam.sources.tables import table

REPEATED = 0.35


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(table(spark, sf, "documents").select("doc_id", "text"))


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(count_tokens(table(spark, sf, "documents").select("doc_id", "source", "text")), "sized")


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixture(_sized(spark, sf), table(spark, sf, "mix_target"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    sized, targets = _sized(spark, sf), table(spark, sf, "mix_target")
    return shares(mixture(sized, targets), sized, targets)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return measure(table(spark, sf, "documents").select("doc_id", "text")).filter(f"share >= {REPEATED}").select("doc_id")


def p8_repetition(spark: SparkSession, sf: str) -> DataFrame:
    return measure(table(spark, sf, "documents").select("doc_id", "text"))


def p8_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Frequent lines of each source, and the documents they leave depleted."""
    return line_frequency(table(spark, sf, "documents").select("doc_id", "source", "text"))


QUERIES = {f.__name__: f for f in (p6_ids, p7_mixture, p7_shares, p8_found, p8_lines, p8_repetition)}
#: Pre-tokens, shuffles by hash and Unicode words have no equal in SQL; tests/llm compare those with brute force.
ORACLE: dict[str, str] = {
    "p8_lines": r"""
with l as (select distinct doc_id, source, unnest(generate_series(1, len(p))) place, unnest(p) line from (select doc_id, source, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) p from documents)),
n as (select doc_id, source, place, trim(regexp_replace(lower(line), '[^\p{L}\p{N}\p{M}]+', ' ', 'g'), ' ') norm from l),
e as (select * from n where norm <> ''),
h as (select source, norm from e group by source, norm having count(distinct doc_id) > 4),
m as (select e.*, h.norm is not null often from e left join h on e.source is not distinct from h.source and e.norm = h.norm),
c as (select doc_id, count(*) n_lines, count(case when often then 1 end) n_removed, sum(length(norm))::bigint n_chars, coalesce(sum(case when not often then length(norm) end), 0)::bigint n_kept from m group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(n_chars, 0) as n_chars, coalesce(n_kept, 0) as n_kept,
  coalesce(n_removed > 0 and n_kept < n_chars * 0.5, false) as rejected
from (select distinct doc_id from documents) d left join c on d.doc_id = c.doc_id""",
}
