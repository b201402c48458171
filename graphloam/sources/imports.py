"""Bringing tables of records into a repository.

A source is a file (CSV, a JSON array, JSON lines) or any DataFrame.  Records map
to nodes of a label, whose declared key picks the key fields, or to relationships
between nodes named by fields.  All of it is one job of Spark however long the
source; the commit carries the source's SHA-256 and how it was read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from graphloam.cypher.errors import BindError, CypherError
from graphloam.cypher.graph import DST, SRC, did_you_mean
from graphloam.version.repo import GraphRepo, key_text


class ImportFailed(CypherError):
    """Records that can't be imported; the message names some of them."""


@dataclass(frozen=True)
class NodeMapping:
    label: str


@dataclass(frozen=True)
class EdgeMapping:
    """``source`` and ``target`` read ``LABEL=field[,field...]``; *discriminator*
    is a field; fields not named become properties."""

    rtype: str
    source: str
    target: str
    discriminator: str | None = None


def read_csv(spark, path: str) -> DataFrame:
    """Cells as text, by the header; quoting as in RFC 4180; an empty cell is null."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


def read_json(spark, path: str) -> DataFrame:
    """One array of flat objects."""
    return _flat(spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path), path)


def read_ndjson(spark, path: str) -> DataFrame:
    """A flat object on each line."""
    return _flat(spark.read.option("mode", "FAILFAST").json(path), path)


READERS = {"csv": read_csv, "json": read_json, "ndjson": read_ndjson}


def _flat(df: DataFrame, path: str) -> DataFrame:
    for f in df.schema.fields:
        kind = f.dataType
        if isinstance(kind, T.ArrayType):
            kind = kind.elementType
            if isinstance(kind, T.ArrayType):
                raise ImportFailed(f"{path}: {f.name} holds lists in lists")
        if isinstance(kind, T.StructType):
            raise ImportFailed(f"{path}: {f.name} holds objects")
    return df


def coerced(df: DataFrame, declared: dict[str, str], what: str) -> DataFrame:
    """Texts as values of their declared types; one that doesn't fit is refused
    with its value.  Undeclared texts stay texts."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out, bad = df, []
    for name, want in declared.items():
        if not isinstance(kinds.get(name), T.StringType) or want in ("string", "list", "duration", "bytes"):
            continue
        text = F.trim(F.col(f"`{name}`"))
        if want == "bool":
            value = F.when(text == "true", True).when(text == "false", False)
        elif want in ("int", "time"):
            value = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
        else:
            value = text.try_cast({"float": "double", "date": "date", "datetime": "timestamp"}[want])
        bad += [f"{what}.{name}: {r[0]!r} is no {want}" for r in out.filter(F.col(f"`{name}`").isNotNull() & value.isNull()).select(f"`{name}`").limit(3).collect()]
        out = out.withColumn(name, value)
    if bad:
        raise ImportFailed("; ".join(bad))
    return out


def sha256(repo: GraphRepo, path: str) -> str:
    """The hash of a file's bytes, read as a stream."""
    jvm = repo.spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(repo.files.conf).open(at)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def import_file(repo: GraphRepo, path: str, mapping: NodeMapping | EdgeMapping, *, format: str | None = None, message: str | None = None) -> str | None:
    """Import a file and commit; None if it changed nothing."""
    format = format or path.rpartition(".")[2].lower().replace("jsonl", "ndjson")
    if format not in READERS:
        raise BindError(f"unknown format {format}" + did_you_mean(format, READERS))
    df = READERS[format](repo.spark, path)
    return import_df(repo, df, mapping, message=message or f"Import {path.rpartition('/')[2]}", trailers={"Source": path.rpartition("/")[2], "Source-SHA256": sha256(repo, path), "Extractor": format})


def import_df(repo: GraphRepo, df: DataFrame, mapping: NodeMapping | EdgeMapping, *, message: str = "Import", trailers: dict | None = None) -> str | None:
    """Import any DataFrame, such as one of a custom reader, and commit.

    Records replace those of the same key.  Records that come several times
    count once; two different records of one key are refused, for nothing
    says which is the later one.
    """
    m = repo.workspace
    before = m.hash
    if isinstance(mapping, NodeMapping):
        _nodes(repo, m, df, mapping)
    else:
        _edges(repo, m, df, mapping)
    if m.hash == before:
        return None
    repo.save(m)
    return repo.commit(message, trailers=trailers)


def _label(m, name: str) -> dict:
    if name not in m.schema["labels"]:
        raise BindError(f"unknown label {name}" + did_you_mean(name, m.schema["labels"]))
    return m.schema["labels"][name]


def _nodes(repo: GraphRepo, m, df: DataFrame, mapping: NodeMapping) -> None:
    d = _label(m, mapping.label)
    repo.put_nodes(m, mapping.label, coerced(df, d["types"], mapping.label).distinct())


def endpoint(m, text: str) -> tuple[str, list[str]]:
    label, equals, rest = text.partition("=")
    names = [x.strip() for x in rest.split(",") if x.strip()]
    if not equals or len(names) != len(_label(m, label)["key"]):
        raise BindError(f"{text}: expected {label}=field for each of {', '.join(_label(m, label)['key'])}")
    return label, names


def _edges(repo: GraphRepo, m, df: DataFrame, mapping: EdgeMapping) -> None:
    (src, from_), (dst, to) = endpoint(m, mapping.source), endpoint(m, mapping.target)
    used = {*from_, *to, *([mapping.discriminator] if mapping.discriminator else [])}
    lost = [x for x in used if x not in df.columns]
    if lost:
        raise BindError(f"no field {', '.join(sorted(lost))}")
    d = m.schema["relationship_types"].get(mapping.rtype)
    if d is None:
        raise BindError(f"unknown relationship type {mapping.rtype}" + did_you_mean(mapping.rtype, m.schema["relationship_types"]))
    cols = [key_text([F.col(f"`{x}`") for x in names]).alias(end) for end, names in ((SRC, from_), (DST, to))]
    rest = [F.col(f"`{x}`") for x in df.columns if x not in used]
    if mapping.discriminator:
        rest.append(F.col(f"`{mapping.discriminator}`").alias(d["discriminator"] or mapping.discriminator))
        if d["discriminator"] is None:
            raise BindError(f"{mapping.rtype} has no discriminator")
    repo.put_edges(m, mapping.rtype, src, dst, coerced(df.select(*cols, *rest), d["types"], mapping.rtype).distinct())
