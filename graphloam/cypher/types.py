"""Static types of query values and their Spark types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as S

from graphloam.cypher.errors import Unsupported

MISSING = object()


@dataclass(frozen=True)
class T:
    """kind: null, bool, int, float, str, list (of), map (fields), dmap (of; keys
    known only at run time), node, rel (fields), path, opaque (a Spark type)."""

    kind: str
    args: tuple = ()

    @property
    def of(self) -> T:
        return self.args[0]

    @property
    def fields(self) -> dict[str, T]:
        return dict(self.args)

    def __str__(self) -> str:
        return self.kind


NULL, BOOL, INT, FLOAT, STR, PATH = (T(k) for k in ("null", "bool", "int", "float", "str", "path"))
NUMBERS = ("int", "float")


def list_of(t: T) -> T:
    return T("list", (t,))


@dataclass(frozen=True)
class Typed:
    """A column with its static type; *const* is its value if it is a literal."""

    col: Column
    type: T
    const: object = MISSING

    @property
    def kind(self) -> str:
        return self.type.kind


def of_spark(t: S.DataType) -> T:
    if isinstance(t, S.BooleanType):
        return BOOL
    if isinstance(t, (S.ByteType, S.ShortType, S.IntegerType, S.LongType)):
        return INT
    if isinstance(t, (S.FloatType, S.DoubleType, S.DecimalType)):
        return FLOAT
    if isinstance(t, (S.StringType, S.CharType, S.VarcharType)):
        return STR
    if isinstance(t, S.NullType):
        return NULL
    if isinstance(t, S.ArrayType):
        return list_of(of_spark(t.elementType))
    if isinstance(t, S.StructType):
        return T("map", tuple(sorted((f.name, of_spark(f.dataType)) for f in t.fields)))
    if isinstance(t, S.MapType):
        return T("dmap", (of_spark(t.valueType),))
    return T("opaque", (t.simpleString(),))


def ddl(t: T) -> str:
    """The Spark type that holds values of *t*."""
    simple = {"null": "string", "bool": "boolean", "int": "bigint", "float": "double", "str": "string"}
    if t.kind in simple:
        return simple[t.kind]
    if t.kind == "list":
        return f"array<{ddl(t.of)}>"
    if t.kind == "dmap":
        return f"map<string,{ddl(t.of)}>"
    if t.kind == "opaque":
        return t.of
    if t.kind in ("map", "node", "rel"):
        return "struct<" + (",".join(f"`{k}`:{ddl(v)}" for k, v in t.args) or "``:string") + ">"
    raise Unsupported(f"no values of type {t}")


def canonical(col: Column, spark: S.DataType) -> Typed:
    """A stored column as a query value: integers of 64 bits, floats double."""
    t = of_spark(spark)
    if t.kind in ("int", "float", "list", "map", "dmap") and spark.simpleString() != ddl(t).replace("`", ""):
        col = col.cast(ddl(t))
    return Typed(col, t)


def unify(types: list[T], what: str) -> T:
    """One type for several values; numbers of both kinds become floats."""
    found = NULL
    for t in types:
        found = _pair(found, t, what)
    return found


def _pair(a: T, b: T, what: str) -> T:
    if a == b or b.kind == "null":
        return a
    if a.kind == "null":
        return b
    if a.kind in NUMBERS and b.kind in NUMBERS:
        return FLOAT
    if a.kind == b.kind == "list":
        return list_of(_pair(a.of, b.of, what))
    if a.kind == b.kind and a.kind in ("map", "node", "rel"):
        fa, fb = a.fields, b.fields
        return T(a.kind, tuple((k, _pair(fa.get(k, NULL), fb.get(k, NULL), what)) for k in sorted({*fa, *fb})))
    raise Unsupported(f"values of the types {a} and {b} together in {what}")


def cast(v: Typed, t: T) -> Column:
    """*v* as a column of the Spark type of *t*."""
    if v.type == t:
        return v.col
    if v.kind == "null":
        return F.lit(None).cast(ddl(t))
    if v.kind == "list" and t.kind == "list":
        if v.type.of.kind == "null":
            return v.col.cast(ddl(t))
        return F.transform(v.col, lambda x: cast(Typed(x, v.type.of), t.of))
    if v.kind in ("map", "node", "rel") and t.kind == v.kind:
        have = v.type.fields
        parts = [(cast(Typed(v.col.getField(k), have[k]), ft) if k in have else F.lit(None).cast(ddl(ft))).alias(k) for k, ft in t.args]
        return F.when(v.col.isNotNull(), F.struct(*parts))
    return v.col.cast(ddl(t))
