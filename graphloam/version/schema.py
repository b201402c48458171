"""Declared labels, relationship types and indexes, and what they demand of data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from graphloam.cypher.errors import CypherError

#: The types that properties can be declared with, as types of Spark.
TYPES = {"bool": "boolean", "int": "bigint", "float": "double", "string": "string", "bytes": "binary", "date": "date", "time": "bigint", "datetime": "timestamp", "duration": "struct<months:bigint,days:bigint,nanos:bigint>", "list": "array"}
EMPTY = {"labels": {}, "relationship_types": {}, "indexes": {}}


class ConstraintError(CypherError):
    """Data and schema contradict each other; ``found`` lists the breaches."""

    def __init__(self, found: list[str]) -> None:
        super().__init__("; ".join(found))
        self.found = found


def label(key: list[str], *, types: dict[str, str] | None = None, required: list[str] = (), unique: list[list[str]] = (), surrogate: bool = False) -> dict:
    if surrogate:
        key = ["_id"]
    if not key:
        raise CypherError("a label needs a key")
    _check_types(types)
    return {"key": list(key), "types": dict(types or {}), "required": list(required), "unique": [list(u) if isinstance(u, (list, tuple)) else [u] for u in unique], "surrogate": surrogate}


def relationship(*, discriminator: str | None = None, types: dict[str, str] | None = None, required: list[str] = ()) -> dict:
    _check_types(types)
    return {"discriminator": discriminator, "types": dict(types or {}), "required": list(required)}


def _check_types(types: dict[str, str] | None) -> None:
    for name, kind in (types or {}).items():
        if kind not in TYPES:
            raise CypherError(f"unknown type {kind} of {name}; known are {', '.join(TYPES)}")


def conforms(declared: str, have: T.DataType) -> bool:
    """Whether stored values of a type can stand where a type is declared."""
    simple = have.simpleString()
    if isinstance(have, T.NullType):
        return True
    if declared == "list":
        return isinstance(have, T.ArrayType)
    if declared == "int":
        return simple in ("bigint", "int", "smallint", "tinyint")
    if declared == "float":
        return simple in ("double", "float", "bigint", "int", "smallint", "tinyint")
    return simple == TYPES[declared]


def stored(df: DataFrame, declared: dict[str, str], known: T.StructType | None, what: str) -> DataFrame:
    """*df* with its columns as the table holds them: of the declared types
    (anything that doesn't conform is refused) or, undeclared, of the table's."""
    old = {f.name: f.dataType for f in known.fields} if known is not None else {}
    bad, cols = [], []
    for f in df.schema.fields:
        col, want = F.col(f"`{f.name}`"), None
        if f.name in declared:
            if not conforms(declared[f.name], f.dataType):
                bad.append(f"{what}.{f.name} is {f.dataType.simpleString()}, declared {declared[f.name]}")
            want = TYPES[declared[f.name]] if declared[f.name] != "list" else None
        elif f.name in old:
            want = old[f.name].simpleString()
        elif f.dataType.simpleString() in ("int", "smallint", "tinyint"):
            want = "bigint"
        elif f.dataType.simpleString() == "float":
            want = "double"
        elif isinstance(f.dataType, T.NullType):
            want = "string"
        cols.append((col.cast(want) if want and want != f.dataType.simpleString() else col).alias(f.name))
    if bad:
        raise ConstraintError(bad)
    return df.select(*cols)


def breaches(df: DataFrame, declared: dict, what: str, key: str) -> list[str]:
    """Rows without a required property and values that should be unique but
    are not; up to five of each are named."""
    found = []
    for p in declared.get("required", []):
        missing = df if p not in df.columns else df.filter(F.col(f"`{p}`").isNull())
        found += [f"{what} {r[0]} has no {p}" for r in missing.select(key).limit(5).collect()]
    for group in declared.get("unique", []):
        if set(group) - set(df.columns):
            continue
        present = df.filter(" and ".join(f"`{p}` is not null" for p in group))
        twice = present.groupBy(*[f"`{p}`" for p in group]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(5).collect()
        found += [f"{what} has {r['n']} records with {', '.join(f'{p} = {r[p]}' for p in group)}" for r in twice]
    return found


def contradictions(df: DataFrame, types: dict[str, str], what: str) -> list[str]:
    """Stored properties that newly declared types contradict."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return [f"{what}.{p} is stored as {have[p].simpleString()}, declared {t}" for p, t in types.items() if p in have and not conforms(t, have[p]) and not df.filter(F.col(f"`{p}`").isNotNull()).isEmpty()]
