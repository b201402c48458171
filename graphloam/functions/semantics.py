"""Where Cypher's values behave unlike Spark's: equality, order, arithmetic.

Every function takes and gives typed columns; all of it stays in Spark's own
expressions.  ANSI mode stays on, so integer overflow and division by zero raise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from graphloam.cypher.errors import CypherTypeError
from graphloam.cypher.types import BOOL, FLOAT, INT, MISSING, NULL, NUMBERS, STR, T, Typed, cast, ddl, list_of, unify

#: Fixed value: a Java pattern for Unicode white space.
WHITE = r"\p{IsWhite_Space}+"


def null(t: T = NULL) -> Typed:
    return Typed(F.lit(None).cast(ddl(t)), t, None)


def literal(v) -> Typed:
    if v is None:
        return null()
    if isinstance(v, bool):
        return Typed(F.lit(v), BOOL, v)
    if isinstance(v, int):
        if not -(1 << 63) <= v < 1 << 63:
            raise CypherTypeError("integer beyond 64 bits")
        return Typed(F.lit(v).cast("bigint"), INT, v)
    if isinstance(v, float):
        return Typed(F.lit(v), FLOAT, v)
    if isinstance(v, str):
        return Typed(F.lit(v), STR, v)
    if isinstance(v, (list, tuple)):
        return list_literal([literal(x) for x in v])
    if isinstance(v, dict):
        return map_literal({k: literal(x) for k, x in v.items()})
    raise CypherTypeError(f"no query value: {type(v).__name__}")


def list_literal(items: list[Typed]) -> Typed:
    t = unify([i.type for i in items], "a list")
    return Typed(F.array(*[cast(i, t) for i in items]).cast(f"array<{ddl(t)}>"), list_of(t))


def map_literal(items: dict[str, Typed]) -> Typed:
    if not items:
        return Typed(F.struct(F.lit(None).cast("string").alias("")), T("map", ()))
    keys = sorted(items)
    return Typed(F.struct(*[items[k].col.alias(k) for k in keys]), T("map", tuple((k, items[k].type) for k in keys)))


def any_null(*vs: Typed) -> Column:
    out = vs[0].col.isNull()
    for v in vs[1:]:
        out = out | v.col.isNull()
    return out


def unless_null(value: Column, *vs: Typed) -> Column:
    """*value* unless one of *vs* is null; literals are not tested."""
    tested = [v for v in vs if v.const is MISSING or v.const is None]
    return F.when(~any_null(*tested), value) if tested else value


def _maybe_nan(v: Typed) -> bool:
    return v.kind == "float" and (v.const is MISSING or isinstance(v.const, float) and math.isnan(v.const))


# -- comparison --------------------------------------------------------------


def eq(a: Typed, b: Typed) -> Column:
    """Three-valued equality.  NaN equals nothing, lists and maps compare
    element by element, values of different kinds are unequal."""
    if "null" in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    if a.kind in NUMBERS and b.kind in NUMBERS:
        same = a.col == b.col
        return same & ~F.isnan(a.col) if _maybe_nan(a) and (b.kind == "int" or _maybe_nan(b)) else same
    if a.kind == b.kind == "list":
        if not _comparable(a.type.of, b.type.of):
            both_empty = (F.size(a.col) == 0) & (F.size(b.col) == 0)
            return unless_null(both_empty, a, b)
        pairs = F.zip_with(a.col, b.col, lambda x, y: eq(Typed(x, a.type.of), Typed(y, b.type.of)))
        return F.when(any_null(a, b), F.lit(None).cast("boolean")).when(F.size(a.col) != F.size(b.col), False).otherwise(F.forall(pairs, lambda x: x))
    if a.kind == b.kind == "map":
        fa, fb = a.type.fields, b.type.fields
        if fa.keys() != fb.keys():
            return unless_null(F.lit(False), a, b)
        out = F.lit(True)
        for k in fa:
            out = out & eq(Typed(a.col.getField(k), fa[k]), Typed(b.col.getField(k), fb[k]))
        return unless_null(out, a, b)
    if a.kind == b.kind == "dmap":
        sort = lambda v: F.array_sort(F.map_entries(v.col))
        return sort(a) == sort(b)
    if a.kind == b.kind and a.kind in ("node", "rel"):
        return (a.col["_l"] == b.col["_l"]) & (a.col["_k"] == b.col["_k"])
    if a.type == b.type:
        return a.col == b.col
    return unless_null(F.lit(False), a, b)


def _comparable(a: T, b: T) -> bool:
    return a == b or "null" in (a.kind, b.kind) or a.kind in NUMBERS and b.kind in NUMBERS or a.kind == b.kind and a.kind in ("list", "map", "node", "rel")


def compare(op: str, a: Typed, b: Typed) -> Typed:
    if op == "=":
        return Typed(eq(a, b), BOOL)
    if op == "<>":
        return Typed(~eq(a, b), BOOL)
    if "null" in (a.kind, b.kind) or a.kind in ("map", "dmap", "node", "rel", "path"):
        return null(BOOL)
    if not (a.kind in NUMBERS and b.kind in NUMBERS or a.type == b.type or a.kind == b.kind == "list"):
        return null(BOOL)
    # Spark holds NaN for greater than all numbers; here it is neither greater nor smaller
    greater = b if op in ("<", "<=") else a
    out = {"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[op]
    if _maybe_nan(greater):
        out = out & ~F.isnan(greater.col)
    return Typed(out, BOOL)


def in_list(x: Typed, xs: Typed) -> Typed:
    if xs.kind == "null":
        return null(BOOL)
    if xs.kind != "list":
        raise CypherTypeError(f"IN needs a list, not {xs.kind}")
    of = xs.type.of
    if x.kind == "null" or of.kind == "null":
        none = F.lit(None).cast("boolean")
        return Typed(F.when(xs.col.isNull(), none).when(F.size(xs.col) == 0, False).otherwise(none), BOOL)
    if x.kind in ("int", "str", "bool") and x.type == of:
        return Typed(F.when(F.size(xs.col) == 0, False).otherwise(F.array_contains(xs.col, x.col)), BOOL)
    found = F.exists(xs.col, lambda y: F.coalesce(eq(x, Typed(y, of)), F.lit(False)))
    unknown = F.exists(xs.col, lambda y: eq(x, Typed(y, of)).isNull())
    return Typed(F.when(xs.col.isNull(), F.lit(None).cast("boolean")).when(found, True).when(unknown, F.lit(None).cast("boolean")).otherwise(False), BOOL)


def logic(op: str, a: Typed, b: Typed) -> Typed:
    x, y = boolean(a), boolean(b)
    return Typed({"AND": x & y, "OR": x | y, "XOR": x != y}[op], BOOL)


def boolean(v: Typed) -> Column:
    if v.kind == "null":
        return F.lit(None).cast("boolean")
    if v.kind != "bool":
        raise CypherTypeError(f"a boolean is needed, not {v.kind}")
    return v.col


def string_predicate(op: str, a: Typed, b: Typed) -> Typed:
    """Null for anything but two strings."""
    if a.kind != "str" or b.kind != "str":
        return null(BOOL)
    return Typed({"STARTS": F.startswith, "ENDS": F.endswith, "CONTAINS": F.contains}[op](a.col, b.col), BOOL)


# -- arithmetic --------------------------------------------------------------


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    if op == "+":
        return add(a, b)
    if "null" in (a.kind, b.kind):
        other = b if a.kind == "null" else a
        if other.kind not in (*NUMBERS, "null"):
            raise CypherTypeError(f"no {op} for {other.kind}")
        return null(FLOAT if op == "^" else other.type)
    if a.kind not in NUMBERS or b.kind not in NUMBERS:
        raise CypherTypeError(f"no {op} between {a.kind} and {b.kind}")
    if op == "^":
        return Typed(F.pow(a.col.cast("double"), b.col.cast("double")), FLOAT)
    if a.kind == b.kind == "int":
        if op == "/":
            return Typed(_div(a.col, b.col), INT)
        return Typed({"-": a.col - b.col, "*": a.col * b.col, "%": a.col % b.col}[op], INT)
    x, y = a.col.cast("double"), b.col.cast("double")
    if op == "/":
        return Typed(float_division(x, y), FLOAT)
    if op == "%":
        return Typed(F.when(y == 0, unless_null(F.lit(float("nan")), a)).otherwise(x % F.nullif(y, F.lit(0.0))), FLOAT)
    return Typed({"-": x - y, "*": x * y}[op], FLOAT)


def _div(x: Column, y: Column) -> Column:
    """Integer division towards zero; by zero it raises."""
    return F.call_function("div", x, y)


def float_division(x: Column, y: Column) -> Column:
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    by_zero = F.when(x.isNull(), F.lit(None).cast("double")).when((x == 0) | F.isnan(x), nan).when(x > 0, inf).otherwise(-inf)
    return F.when(y == 0, by_zero).otherwise(x / F.nullif(y, F.lit(0.0)))


def negate(v: Typed) -> Typed:
    if v.kind == "null":
        return v
    if v.kind not in NUMBERS:
        raise CypherTypeError(f"no minus for {v.kind}")
    return Typed(-v.col, v.type, -v.const if isinstance(v.const, (int, float)) and v.const != -(1 << 63) else MISSING)


def add(a: Typed, b: Typed) -> Typed:
    """Numbers add, strings and lists concatenate, a list takes an element."""
    if a.kind == "list" or b.kind == "list":
        if a.kind == b.kind:
            t = unify([a.type, b.type], "a list")
            return Typed(F.concat(cast(a, t), cast(b, t)), t)
        xs, x = (a, b) if a.kind == "list" else (b, a)
        if x.kind == "null":
            return null(xs.type)
        t = unify([xs.type.of, x.type], "a list")
        one = F.array(cast(x, t))
        whole = cast(xs, list_of(t))
        return Typed(unless_null(F.concat(whole, one) if xs is a else F.concat(one, whole), xs), list_of(t))
    if "null" in (a.kind, b.kind):
        return null(b.type if a.kind == "null" else a.type)
    if a.kind in NUMBERS and b.kind in NUMBERS:
        return Typed(a.col + b.col, INT if a.kind == b.kind == "int" else FLOAT)
    if "str" in (a.kind, b.kind) and {a.kind, b.kind} <= {"str", *NUMBERS}:
        return Typed(F.concat(to_string(a).col, to_string(b).col), STR)
    raise CypherTypeError(f"no + between {a.kind} and {b.kind}")


# -- conversion --------------------------------------------------------------


def to_string(v: Typed) -> Typed:
    if v.kind in ("str", "null"):
        return Typed(v.col.cast("string"), STR)
    if v.kind == "float":
        return Typed(_float_text(v.col), STR)
    if v.kind in ("int", "bool"):
        return Typed(v.col.cast("string"), STR)
    if v.kind == "opaque":
        return Typed(F.lower(F.hex(v.col)) if v.type.of == "binary" else v.col.cast("string"), STR)
    raise CypherTypeError(f"no text for {v.kind}")


def _float_text(x: Column) -> Column:
    """Shortest text without an exponent; at least one decimal below 1e15."""
    text = x.cast("string")
    whole = (F.floor(x) == x) & (F.abs(x) < 1e15)
    plain = F.concat(x.try_cast("decimal(20,0)").cast("string"), F.lit(".0"))
    big = x.try_cast("decimal(38,0)").cast("string")
    small = F.rtrim(x.try_cast("decimal(38,18)").cast("string"), F.lit("0"))
    special = F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    shifted = F.when(F.abs(x) >= 1, F.coalesce(big, text)).otherwise(F.coalesce(small, text))
    return F.when(x.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(special, F.when((x == 0) & text.startswith("-"), "-0.0").when(whole, plain).when(text.contains("E"), shifted).otherwise(text)))


def trimmed(x: Column, left: bool = True, right: bool = True) -> Column:
    if left:
        x = F.regexp_replace(x, "^" + WHITE, "")
    return F.regexp_replace(x, WHITE + r"\z", "") if right else x


def to_integer(v: Typed) -> Typed:
    if v.kind in ("int", "null"):
        return Typed(v.col.cast("bigint"), INT)
    if v.kind == "float":
        return Typed(_saturated(v.col), INT)
    if v.kind == "str":
        s = trimmed(v.col)
        real = F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))
        return Typed(F.coalesce(F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint")), _saturated(real)), INT)
    raise CypherTypeError(f"no integer from {v.kind}")


def _saturated(x: Column) -> Column:
    least, most = -(1 << 63), (1 << 63) - 1
    return F.when(F.isnan(x), 0).when(x >= float(most), most).when(x <= float(least), least).otherwise(x.try_cast("bigint"))


def to_float(v: Typed) -> Typed:
    if v.kind in (*NUMBERS, "null"):
        return Typed(v.col.cast("double"), FLOAT)
    if v.kind == "str":
        s = trimmed(v.col)
        return Typed(F.when(s.rlike(r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"), s.try_cast("double")), FLOAT)
    raise CypherTypeError(f"no float from {v.kind}")


def to_boolean(v: Typed) -> Typed:
    if v.kind in ("bool", "null"):
        return Typed(v.col.cast("boolean"), BOOL)
    if v.kind == "str":
        s = F.lower(trimmed(v.col))
        return Typed(F.when(s == "true", True).when(s == "false", False), BOOL)
    raise CypherTypeError(f"no boolean from {v.kind}")
