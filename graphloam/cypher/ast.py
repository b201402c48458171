"""Syntax trees."""

from __future__ import annotations

from dataclasses import dataclass


class Expr:
    """Base of expressions."""


@dataclass(frozen=True)
class Lit(Expr):
    value: object


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    of: Expr
    key: str


@dataclass(frozen=True)
class ListLit(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MapLit(Expr):
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    of: Expr


@dataclass(frozen=True)
class Binary(Expr):
    """Arithmetic, AND, OR, XOR, IN, STARTS, ENDS, CONTAINS, =~."""

    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Compare(Expr):
    """``a < b <= c``: each neighbouring pair must hold."""

    first: Expr
    rest: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class IsNull(Expr):
    of: Expr
    negated: bool


@dataclass(frozen=True)
class HasLabels(Expr):
    of: Expr
    labels: tuple[str, ...]


@dataclass(frozen=True)
class Index(Expr):
    of: Expr
    at: Expr


@dataclass(frozen=True)
class Slice(Expr):
    of: Expr
    lo: Expr | None
    hi: Expr | None


@dataclass(frozen=True)
class Case(Expr):
    subject: Expr | None
    arms: tuple[tuple[Expr, Expr], ...]
    default: Expr | None


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class ListComp(Expr):
    var: str
    of: Expr
    where: Expr | None
    result: Expr | None


@dataclass(frozen=True)
class Quantifier(Expr):
    kind: str
    var: str
    of: Expr
    where: Expr


@dataclass(frozen=True)
class Reduce(Expr):
    acc: str
    init: Expr
    var: str
    of: Expr
    result: Expr


@dataclass(frozen=True)
class NodePat:
    var: str | None
    labels: tuple[str, ...]
    props: Expr | None


@dataclass(frozen=True)
class RelPat:
    var: str | None
    types: tuple[str, ...]
    direction: str  # out, in, both
    hops: tuple[int, int | None] | None
    props: Expr | None


@dataclass(frozen=True)
class Path:
    var: str | None
    nodes: tuple[NodePat, ...]
    rels: tuple[RelPat, ...]


@dataclass(frozen=True)
class PatternPred(Expr):
    path: Path


@dataclass(frozen=True)
class PatternComp(Expr):
    path: Path
    where: Expr | None
    result: Expr


class Clause:
    """Base of clauses."""


@dataclass(frozen=True)
class Match(Clause):
    optional: bool
    paths: tuple[Path, ...]
    where: Expr | None
    at: Expr | None = None


@dataclass(frozen=True)
class Unwind(Clause):
    of: Expr
    var: str


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None
    text: str


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool


@dataclass(frozen=True)
class Project(Clause):
    """WITH (``final`` false) or RETURN."""

    final: bool
    distinct: bool
    star: bool
    items: tuple[Item, ...]
    order: tuple[Order, ...]
    skip: Expr | None
    limit: Expr | None
    where: Expr | None


@dataclass(frozen=True)
class Create(Clause):
    paths: tuple[Path, ...]


@dataclass(frozen=True)
class SetItem:
    """kind: prop (x.k = v), replace (x = m), merge (x += m), labels (x:A:B)."""

    kind: str
    target: Expr
    key: str | None
    value: Expr | None
    labels: tuple[str, ...] = ()


@dataclass(frozen=True)
class Merge(Clause):
    path: Path
    on_create: tuple[SetItem, ...]
    on_match: tuple[SetItem, ...]


@dataclass(frozen=True)
class Set(Clause):
    items: tuple[SetItem, ...]


@dataclass(frozen=True)
class Remove(Clause):
    items: tuple[SetItem, ...]


@dataclass(frozen=True)
class Delete(Clause):
    detach: bool
    targets: tuple[Expr, ...]


@dataclass(frozen=True)
class CallProc(Clause):
    name: str
    args: tuple[Expr, ...] | None
    yields: tuple[tuple[str, str], ...] | None
    star: bool
    where: Expr | None


@dataclass(frozen=True)
class Query:
    clauses: tuple[Clause, ...]
    text: str

    @property
    def writes(self) -> bool:
        return any(isinstance(c, (Create, Merge, Set, Remove, Delete)) for c in self.clauses)


def children(node) -> list:
    """Direct sub-nodes (expressions, patterns, items) of any node."""
    out = []

    def add(v) -> None:
        if isinstance(v, tuple):
            for x in v:
                add(x)
        elif hasattr(v, "__dataclass_fields__"):
            out.append(v)

    for f in node.__dataclass_fields__:
        add(getattr(node, f))
    return out


def walk(node):
    """The node and everything below it, without recursion."""
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(reversed(children(x)))
