"""The scalar functions.  A null argument gives null, but for coalesce and range."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from graphloam.cypher.errors import CypherTypeError
from graphloam.cypher.types import BOOL, FLOAT, INT, NUMBERS, STR, T, Typed, cast, list_of, unify
from graphloam.functions import semantics as M


@dataclass(frozen=True)
class Function:
    least: int
    most: int
    run: Callable[[list[Typed]], Typed]


FUNCTIONS: dict[str, Function] = {}


def _function(name: str, least: int = 1, most: int | None = None):
    def add(run):
        FUNCTIONS[name.lower()] = Function(least, least if most is None else most, run)
        return run

    return add


def _need(v: Typed, kinds: tuple[str, ...], name: str) -> None:
    if v.kind not in (*kinds, "null"):
        raise CypherTypeError(f"{name} takes no {v.kind}")


def _raise_if(bad: Column, message: str, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(value)


def _numeric(name: str, make: Callable[[Column], Column]):
    @_function(name)
    def run(args: list[Typed]) -> Typed:
        _need(args[0], NUMBERS, name)
        return M.null(FLOAT) if args[0].kind == "null" else Typed(make(args[0].col.cast("double")), FLOAT)


@_function("abs")
def _abs(args):
    _need(args[0], NUMBERS, "abs")
    return args[0] if args[0].kind == "null" else Typed(F.abs(args[0].col), args[0].type)


_numeric("ceil", lambda x: _whole(F.ceil, x))
_numeric("floor", lambda x: _whole(F.floor, x))
_numeric("round", lambda x: F.when(F.abs(x) >= 4503599627370496.0, x).otherwise(F.signum(x) * F.floor(F.abs(x) + 0.5).cast("double") + F.lit(0.0)))
_numeric("sqrt", F.sqrt)


def _whole(f, x: Column) -> Column:
    """Floats beyond 2^52 are whole, and may be beyond 64-bit integers."""
    return F.when(F.isnan(x) | (F.abs(x) >= 4503599627370496.0), x).otherwise(f(x).cast("double"))


@_function("sign")
def _sign(args):
    _need(args[0], NUMBERS, "sign")
    x = args[0].col
    return M.null(INT) if args[0].kind == "null" else Typed(F.when(F.isnan(x.cast("double")), 0).otherwise(F.signum(x)).cast("bigint"), INT)


@_function("coalesce", 1, 10_000)
def _coalesce(args):
    t = unify([a.type for a in args], "coalesce")
    return Typed(F.coalesce(*[cast(a, t) for a in args]), t)


FUNCTIONS["tostring"] = Function(1, 1, lambda a: M.to_string(a[0]))
FUNCTIONS["tointeger"] = Function(1, 1, lambda a: M.to_integer(a[0]))
FUNCTIONS["tofloat"] = Function(1, 1, lambda a: M.to_float(a[0]))
FUNCTIONS["toboolean"] = Function(1, 1, lambda a: M.to_boolean(a[0]))


def _text(name: str, make: Callable[[Column], Column]):
    @_function(name)
    def run(args):
        _need(args[0], ("str",), name)
        return Typed(make(args[0].col), STR)


_text("toUpper", F.upper)
_text("toLower", F.lower)
_text("trim", M.trimmed)
_text("lTrim", lambda x: M.trimmed(x, right=False))
_text("rTrim", lambda x: M.trimmed(x, left=False))


@_function("left", 2)
def _left(args):
    _need(args[0], ("str",), "left"), _need(args[1], ("int",), "left")
    s, n = args[0].col, args[1].col
    return Typed(M.unless_null(_raise_if(n < 0, "left: negative length", F.substring(s, F.lit(1), F.least(n, F.lit(2**31 - 1)).cast("int"))), *args), STR)


@_function("right", 2)
def _right(args):
    _need(args[0], ("str",), "right"), _need(args[1], ("int",), "right")
    s, n = args[0].col, F.least(args[1].col, F.char_length(args[0].col).cast("bigint")).cast("int")
    return Typed(M.unless_null(_raise_if(args[1].col < 0, "right: negative length", F.when(n == 0, "").otherwise(F.substring(s, F.char_length(s) - n + 1, n))), *args), STR)


@_function("substring", 2, 3)
def _substring(args):
    _need(args[0], ("str",), "substring")
    for a in args[1:]:
        _need(a, ("int",), "substring")
    most = F.lit(2**31 - 2)
    s, at = args[0].col, F.least(args[1].col, most).cast("int")
    n = F.least(args[2].col, most).cast("int") if len(args) > 2 else most
    bad = args[1].col < 0
    if len(args) > 2:
        bad = bad | (args[2].col < 0)
    return Typed(M.unless_null(_raise_if(bad, "substring: negative argument", F.substring(s, at + 1, n)), *args), STR)


@_function("replace", 3)
def _replace(args):
    for a in args:
        _need(a, ("str",), "replace")
    s, find, put = (a.col for a in args)
    spread = F.concat(put, F.array_join(F.transform(F.split(s, ""), lambda c: F.concat(c, put)), ""))
    spread = F.when(F.char_length(s) == 0, put).otherwise(spread)
    return Typed(M.unless_null(F.when(find == "", spread).otherwise(F.replace(s, find, put)), *args), STR)


@_function("split", 2)
def _split(args):
    for a in args:
        _need(a, ("str",), "split")
    s, sep = (a.col for a in args)
    quoted = F.concat(F.lit("\\Q"), F.replace(sep, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    chars = F.when(F.char_length(s) == 0, F.array(F.lit(""), F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.split(s, ""), F.array(F.lit(""))))
    return Typed(M.unless_null(F.when(sep == "", chars).otherwise(F.call_function("split", s, quoted, F.lit(-1))), *args), list_of(STR))


@_function("reverse")
def _reverse(args):
    _need(args[0], ("str", "list"), "reverse")
    return Typed(F.reverse(args[0].col), args[0].type)


@_function("size")
def _size(args):
    v = args[0]
    _need(v, ("str", "list", "map", "dmap"), "size")
    if v.kind == "map":
        return Typed(M.unless_null(F.lit(len(v.type.args)).cast("bigint"), v), INT)
    return length_of(v)


def length_of(v: Typed) -> Typed:
    if v.kind == "null":
        return M.null(INT)
    count = F.char_length(v.col) if v.kind == "str" else F.call_function("cardinality", v.col)
    return Typed(M.unless_null(count.cast("bigint"), v), INT)


@_function("length")
def _length(args):
    v = args[0]
    if v.kind == "path":
        return Typed(M.unless_null(F.size(v.col["rels"]).cast("bigint"), v), INT)
    _need(v, ("str", "list"), "length")
    return length_of(v)


@_function("head")
def _head(args):
    _need(args[0], ("list",), "head")
    return M.null() if args[0].kind == "null" else Typed(F.get(args[0].col, F.lit(0)), args[0].type.of)


@_function("last")
def _last(args):
    _need(args[0], ("list",), "last")
    return M.null() if args[0].kind == "null" else Typed(F.try_element_at(args[0].col, F.lit(-1)), args[0].type.of)


@_function("tail")
def _tail(args):
    _need(args[0], ("list",), "tail")
    xs = args[0].col
    return args[0] if args[0].kind == "null" else Typed(F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))), args[0].type)


@_function("range", 2, 3)
def _range(args):
    for a in args:
        if a.kind != "int":
            raise CypherTypeError("range takes integers")
    a, b = args[0].col, args[1].col
    step = args[2].col if len(args) > 2 else F.lit(1).cast("bigint")
    none = F.array().cast("array<bigint>")
    wrong_way = F.when(step > 0, b < a).otherwise(b > a)
    steps = F.when(wrong_way, none).otherwise(F.sequence(a, b, step))
    out = _raise_if(step == 0, "range: step is 0", steps) if len(args) > 2 else steps
    missing = M.any_null(*args)
    return Typed(F.when(missing, F.raise_error(F.lit("range: null argument"))).otherwise(out), list_of(INT))


@_function("keys")
def _keys(args):
    v = args[0]
    _need(v, ("map", "dmap", "node", "rel"), "keys")
    if v.kind == "null":
        return M.null(list_of(STR))
    if v.kind == "dmap":
        return Typed(F.array_sort(F.map_keys(v.col)), list_of(STR))
    if v.kind == "map":
        return Typed(M.unless_null(F.array(*[F.lit(k) for k in v.type.fields]).cast("array<string>"), v), list_of(STR))
    props = v.type.fields["properties"]
    present = [F.when(v.col["properties"].getField(k).isNotNull(), F.lit(k)) for k in sorted(props.fields)]
    return Typed(M.unless_null(F.array_compact(F.array(*present).cast("array<string>")), v), list_of(STR))


@_function("properties")
def _properties(args):
    v = args[0]
    _need(v, ("map", "dmap", "node", "rel"), "properties")
    if v.kind in ("node", "rel"):
        return Typed(v.col["properties"], v.type.fields["properties"])
    return v


@_function("labels")
def _labels(args):
    _need(args[0], ("node",), "labels")
    return M.null(list_of(STR)) if args[0].kind == "null" else Typed(args[0].col["labels"], list_of(STR))


@_function("type")
def _type(args):
    _need(args[0], ("rel",), "type")
    return M.null(STR) if args[0].kind == "null" else Typed(args[0].col["type"], STR)


@_function("nodes")
def _nodes(args):
    raise CypherTypeError("nodes takes a path")


@_function("relationships")
def _relationships(args):
    raise CypherTypeError("relationships takes a path")


@_function("startNode")
def _start(args):
    raise CypherTypeError("startNode takes a relationship")


@_function("endNode")
def _end(args):
    raise CypherTypeError("endNode takes a relationship")


_ = (BOOL, T)
