"""A graph as one table per node label and one per relationship type and pair
of endpoint labels."""

from __future__ import annotations

import difflib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as S

from graphloam.cypher.errors import BindError
from graphloam.cypher.types import T, Typed, canonical, of_spark

KEY, LABELS, SRC, DST, EID = "_k", "_labels", "_src", "_dst", "_id"


@dataclass(frozen=True)
class NodeTable:
    """``_k`` identifies a node within its label; ``_labels`` (optional) holds
    its secondary labels in canonical order; all other columns are properties."""

    label: str
    df: DataFrame
    keys: tuple[str, ...] = ()

    @property
    def props(self) -> dict[str, S.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields if f.name not in (KEY, LABELS)}

    @property
    def has_labels(self) -> bool:
        return LABELS in self.df.columns


@dataclass(frozen=True)
class RelTable:
    """``_src`` and ``_dst`` refer to ``_k`` of the endpoint labels; ``_id`` is
    unique within the type; all other columns are properties.  ``once`` names
    the ends, src or dst, that no two rows share; only the order of joins, no
    result, depends on it."""

    type: str
    src_label: str
    dst_label: str
    df: DataFrame
    discriminator: str | None = None
    once: tuple[str, ...] = ()

    @property
    def props(self) -> dict[str, S.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields if f.name not in (SRC, DST, EID)}


@dataclass
class Graph:
    spark: SparkSession
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    rels: list[RelTable] = field(default_factory=list)

    def __post_init__(self) -> None:
        kinds = {t.df.schema[KEY].dataType.simpleString() for t in self.nodes.values()}
        #: keys of one type join as they are; else all are texts
        self.key_type = "bigint" if kinds and kinds <= {"bigint", "int", "smallint", "tinyint"} else "string"
        self.labels = sorted(self.nodes)
        self.types = sorted({r.type for r in self.rels})

    @property
    def strict(self) -> bool:
        """Unknown names are errors once anything is declared."""
        return bool(self.nodes)

    @property
    def secondary(self) -> bool:
        return any(t.has_labels for t in self.nodes.values())

    def label_code(self, label: str) -> int:
        return self.labels.index(label)

    def type_code(self, rtype: str) -> int:
        return self.types.index(rtype)

    def check_label(self, label: str) -> None:
        if self.strict and label not in self.nodes and not self.secondary:
            raise BindError(f"unknown label {label}" + did_you_mean(label, self.labels))

    def check_type(self, rtype: str) -> None:
        if self.strict and rtype not in self.types:
            raise BindError(f"unknown relationship type {rtype}" + did_you_mean(rtype, self.types))

    # -- properties over several tables

    def node_props(self, labels: list[str]) -> dict[str, T]:
        return _merged([self.nodes[n].props for n in labels])

    def rel_props(self, tables: list[RelTable]) -> dict[str, T]:
        return _merged([t.props for t in tables])

    # -- scans

    def scan_nodes(self, labels: list[str], prefix: str, props: dict[str, T], with_labels: bool, must: tuple[str, ...] = ()) -> DataFrame:
        """Rows of the label tables as ``<prefix>_l, <prefix>_k``, properties as
        ``<prefix>.name`` and, if asked for, ``<prefix>_labels``; labels in
        *must* other than a table's own are tested."""
        frames = []
        for label in labels:
            t = self.nodes[label]
            df = t.df
            for m in must:
                if m != label:
                    df = df.filter(F.array_contains(LABELS, m)) if t.has_labels else None
                    if df is None:
                        break
            if df is None:
                continue
            cols = [F.lit(self.label_code(label)).alias(f"{prefix}_l"), F.col(KEY).cast(self.key_type).alias(f"{prefix}_k")]
            if with_labels:
                own = F.array(F.lit(label))
                both = F.concat(own, F.coalesce(F.col(LABELS), F.array().cast("array<string>"))) if t.has_labels else own
                cols.append(both.alias(f"{prefix}_labels"))
            frames.append(df.select(*cols, *_columns(t.props, prefix, props)))
        if not frames:
            cols = [F.lit(0).alias(f"{prefix}_l"), F.lit(None).cast(self.key_type).alias(f"{prefix}_k")]
            cols += [F.array().cast("array<string>").alias(f"{prefix}_labels")] if with_labels else []
            return self.spark.range(0).select(*cols, *_columns({}, prefix, props))
        return _union(frames)

    def scan_rels(self, tables: list[RelTable], prefix: str, props: dict[str, T]) -> DataFrame:
        """``<prefix>_t, _id, _sl, _sk, _dl, _dk`` and properties."""
        frames = []
        for t in tables:
            lit = lambda v, n: F.lit(v).alias(f"{prefix}_{n}")
            cols = [
                lit(self.type_code(t.type), "t"),
                F.col(EID).cast("string" if self._text_ids else "bigint").alias(f"{prefix}_id"),
                lit(self.label_code(t.src_label), "sl"),
                F.col(SRC).cast(self.key_type).alias(f"{prefix}_sk"),
                lit(self.label_code(t.dst_label), "dl"),
                F.col(DST).cast(self.key_type).alias(f"{prefix}_dk"),
            ]
            frames.append(t.df.select(*cols, *_columns(t.props, prefix, props)))
        if not frames:
            kinds = {"t": "int", "id": "string" if self._text_ids else "bigint", "sl": "int", "sk": self.key_type, "dl": "int", "dk": self.key_type}
            return self.spark.range(0).select(*[F.lit(None).cast(k).alias(f"{prefix}_{n}") for n, k in kinds.items()], *_columns({}, prefix, props))
        return _union(frames)

    @property
    def _text_ids(self) -> bool:
        return any(r.df.schema[EID].dataType.simpleString() not in ("bigint", "int") for r in self.rels)


def _merged(tables: list[dict[str, S.DataType]]) -> dict[str, T]:
    """Types of properties over tables; where they clash, texts."""
    out: dict[str, T] = {}
    for props in tables:
        for k, dt in props.items():
            t = of_spark(dt)
            old = out.get(k, t)
            if old == t:
                out[k] = t
            elif {old.kind, t.kind} <= {"int", "float"}:
                out[k] = T("float")
            else:
                out[k] = T("str")
    return out


def _columns(have: dict[str, S.DataType], prefix: str, want: dict[str, T]) -> list[Column]:
    from graphloam.cypher.types import ddl

    out = []
    for k, t in want.items():
        if k in have:
            v: Typed = canonical(F.col(f"`{k}`"), have[k])
            col = v.col if v.type == t else v.col.cast(ddl(t))
        else:
            col = F.lit(None).cast(ddl(t))
        out.append(col.alias(f"{prefix}.{k}"))
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def did_you_mean(name: str, known) -> str:
    near = difflib.get_close_matches(name, list(known), 1, 0.6)
    folded = [k for k in known if k.lower() == name.lower()]
    return f"; did you mean {(folded or near)[0]}?" if folded or near else ""
