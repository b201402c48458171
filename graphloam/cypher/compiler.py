"""A query as one DataFrame.

Each clause turns the frame of bound rows into the next; nothing is executed
here.  A node variable is not a struct: it is its label code, its key and just
those property columns that the query mentions, so that Catalyst prunes and
pushes down as for any hand-written join.  A pattern is compiled by itself, with
variables bound before as open ends of edge tables, and then joined to the frame
on those ends: inner for MATCH, left outer for OPTIONAL MATCH, semi or anti for
pattern predicates, grouped for pattern comprehensions.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from graphloam.cypher import ast as A
from graphloam.cypher.errors import BindError, CypherTypeError, Unsupported
from graphloam.cypher.graph import Graph, RelTable, did_you_mean
from graphloam.cypher.types import BOOL, FLOAT, INT, NULL, STR, T, Typed, cast, ddl, list_of, of_spark, unify
from graphloam.functions import semantics as M
from graphloam.functions.scalar import FUNCTIONS, length_of
from graphloam.session import materialize

AGGREGATES = ("count", "sum", "avg", "min", "max", "collect")
ALL = "*"
UNROLLED = 8


# -- bindings ----------------------------------------------------------------


@dataclass(frozen=True)
class Value:
    """A value in one column."""

    col: str
    type: T

    def columns(self) -> list[str]:
        return [self.col]


@dataclass(frozen=True)
class Node:
    """A node: ``<prefix>_l, _k``, properties, labels if kept."""

    prefix: str
    labels: tuple[str, ...]  # possible primary labels
    props: tuple[tuple[str, T], ...] = ()
    has_labels: bool = False

    def columns(self) -> list[str]:
        return [f"{self.prefix}_l", f"{self.prefix}_k", *([f"{self.prefix}_labels"] if self.has_labels else []), *[f"{self.prefix}.{k}" for k, _ in self.props]]


@dataclass(frozen=True)
class Rel:
    """A relationship: type code, id, both ends, properties."""

    prefix: str
    tables: tuple[RelTable, ...] = field(compare=False)
    props: tuple[tuple[str, T], ...] = ()

    def columns(self) -> list[str]:
        return [f"{self.prefix}_{n}" for n in ("t", "id", "sl", "sk", "dl", "dk")] + [f"{self.prefix}.{k}" for k, _ in self.props]


@dataclass(frozen=True)
class Path:
    """A path of bound parts; rels are Rel or Value (a list of relationships)."""

    nodes: tuple[Node | None, ...]
    rels: tuple
    prefix: str

    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for part in (*self.nodes, *self.rels) if part is not None for c in part.columns()))


Scope = dict


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def _conjuncts(e: A.Expr | None) -> list[A.Expr]:
    if e is None:
        return []
    if isinstance(e, A.Binary) and e.op == "AND":
        return _conjuncts(e.left) + _conjuncts(e.right)
    return [e]


# -- what a query needs of each variable -------------------------------------


class Needs:
    """Per variable name the properties mentioned anywhere; ``*`` for all."""

    def __init__(self, query: A.Query) -> None:
        self.of: dict[str, set[str]] = {}
        self.links: list[tuple[str, str]] = []
        for clause in query.clauses:
            self._visit(clause)
        for _ in range(len(self.links) + 1):
            for new, old in self.links:
                self.of.setdefault(old, set()).update(self.of.get(new, ()))

    def get(self, name: str | None) -> set[str]:
        return self.of.get(name, set()) if name else set()

    def add(self, name: str, what: str) -> None:
        self.of.setdefault(name, set()).add(what)

    def _visit(self, node) -> None:
        stack = [node]
        while stack:
            x = stack.pop()
            if isinstance(x, A.Prop) and isinstance(x.of, A.Var):
                self.add(x.of.name, x.key)
            elif isinstance(x, A.Index) and isinstance(x.of, A.Var) and isinstance(x.at, A.Lit) and isinstance(x.at.value, str):
                self.add(x.of.name, x.at.value)
            elif isinstance(x, A.HasLabels) and isinstance(x.of, A.Var):
                self.add(x.of.name, "@labels")
            elif isinstance(x, A.IsNull) and isinstance(x.of, A.Var):
                pass
            elif isinstance(x, A.Compare) and all(isinstance(e, A.Var) for e in (x.first, *[e for _, e in x.rest])):
                pass
            elif isinstance(x, A.Call) and len(x.args) == 1 and isinstance(x.args[0], A.Var) and x.name.lower() in ("count", "labels", "type", "length", "startnode", "endnode"):
                if x.name.lower() == "labels":
                    self.add(x.args[0].name, "@labels")
            elif isinstance(x, A.Project):
                if x.star and x.final:
                    self.add(ALL, ALL)
                for item in x.items:
                    if isinstance(item.expr, A.Var):
                        if x.final:
                            self.add(item.expr.name, ALL)
                        else:
                            self.links.append((item.alias or item.expr.name, item.expr.name))
                    else:
                        stack.append(item.expr)
                stack.extend(o.expr for o in x.order if not isinstance(o.expr, A.Var))
                stack.extend(e for e in (x.skip, x.limit, x.where) if e is not None)
            elif isinstance(x, A.Path):
                if x.var:
                    self.links.extend((x.var, part.var) for part in (*x.nodes, *x.rels) if part.var)
                stack.extend((*x.nodes, *x.rels))
            elif isinstance(x, (A.NodePat, A.RelPat)):
                if x.var and isinstance(x.props, A.MapLit):
                    for k, _ in x.props.items:
                        self.add(x.var, k)
                if x.props is not None:
                    stack.append(x.props)
            elif isinstance(x, (A.Delete,)):
                stack.extend(e for e in x.targets if not isinstance(e, A.Var))
            elif isinstance(x, A.SetItem):
                if isinstance(x.target, A.Var):
                    self.add(x.target.name, ALL)
                if x.value is not None:
                    stack.append(x.value)
            elif isinstance(x, A.Var):
                self.add(x.name, ALL)
            else:
                stack.extend(A.children(x))


# -- compiler ----------------------------------------------------------------


class Compiler:
    def __init__(self, graph: Graph, params: dict | None = None, *, at: Callable[[str], Graph] | None = None, procedures: dict | None = None) -> None:
        self.graph = graph
        self.params = params or {}
        self.at = at
        self.procedures = procedures or {}
        self.ids = itertools.count()
        self.df: DataFrame | None = None
        self.scope: Scope = {}
        self.needs: Needs | None = None
        self.as_set = False  # how often a row comes makes no difference to the result

    # -- helpers

    def fresh(self, hint: str) -> str:
        safe = "".join(ch if ch.isalnum() else "_" for ch in hint)
        return f"{safe}#{next(self.ids)}"

    @property
    def spark(self):
        return self.graph.spark

    def frame(self) -> DataFrame:
        """The rows so far; one empty row before the first clause."""
        if self.df is None:
            self.df = self.spark.range(1).select()
        return self.df

    def run(self, query: A.Query) -> DataFrame:
        self.needs = Needs(query)
        as_sets = _as_sets(query.clauses)
        for i, clause in enumerate(query.clauses):
            self.as_set = as_sets[i]
            self.clause(clause)
            if self.as_set and isinstance(clause, A.Match) and any(isinstance(x, A.Match) and x.paths and any(p.rels for p in x.paths) for x in query.clauses[i + 1 :]):
                self.narrow(query.clauses[i + 1 :])
        last = query.clauses[-1]
        if isinstance(last, A.Project):
            return self.df
        if isinstance(last, A.CallProc):
            return self.df.select(*[self.value(self.scope[n]).col.alias(n) for n in self.scope])
        return self.frame().limit(0).select()

    def clause(self, clause: A.Clause) -> None:
        if isinstance(clause, A.Match):
            self.match(clause)
        elif isinstance(clause, A.Unwind):
            self.unwind(clause)
        elif isinstance(clause, A.Project):
            self.project(clause)
        elif isinstance(clause, A.CallProc):
            self.call(clause)
        else:
            raise Unsupported(f"{type(clause).__name__} needs a session that can write")

    def narrow(self, rest: tuple[A.Clause, ...]) -> None:
        """Drop variables that no later clause reads, and rows that differ in
        them alone: what follows looks at rows as a set."""
        if any(isinstance(x, A.Project) and x.star for x in rest):
            return
        read = {n for clause in rest for n in _names(clause)}
        kept = {n: b for n, b in self.scope.items() if n in read}
        columns = list(dict.fromkeys(x for b in kept.values() for x in b.columns()))
        if kept and len(kept) < len(self.scope) and columns:
            keys = list(dict.fromkeys(x for b in kept.values() for x in _identity(b)))
            self.df = self.df.select(*[c(x) for x in columns]).dropDuplicates(keys)
            self.scope = kept

    def lookup(self, name: str, scope: Scope):
        if name not in scope:
            raise BindError(f"unknown variable {name}" + did_you_mean(name, scope))
        return scope[name]

    # -- entities as values

    def value(self, b) -> Typed:
        if isinstance(b, Typed):
            return b
        if isinstance(b, Value):
            return Typed(c(b.col), b.type)
        if isinstance(b, Node):
            return self.node_value(b)
        if isinstance(b, Rel):
            return self.rel_value(b)
        return self.path_value(b)

    def label_names(self, b: Node) -> Column:
        if b.has_labels:
            return c(f"{b.prefix}_labels")
        return F.array(self._name(self.graph.labels, b.labels, c(f"{b.prefix}_l")))

    @staticmethod
    def _name(names: list[str], possible, code: Column) -> Column:
        if len(possible) == 1:
            return F.lit(possible[0])
        return F.get(F.array(*[F.lit(n) for n in names]).cast("array<string>"), code)

    @staticmethod
    def _props(b) -> tuple[Column, T]:
        if not b.props:
            return F.struct(F.lit(None).cast("string").alias("")), T("map", ())
        ordered = sorted(b.props)
        return F.struct(*[c(f"{b.prefix}.{k}").alias(k) for k, _ in ordered]), T("map", tuple(ordered))

    def node_value(self, b: Node) -> Typed:
        props, kind = self._props(b)
        col = F.struct(c(f"{b.prefix}_k").alias("_k"), c(f"{b.prefix}_l").alias("_l"), self.label_names(b).alias("labels"), props.alias("properties"))
        key = STR if self.graph.key_type == "string" else INT
        return Typed(F.when(c(f"{b.prefix}_k").isNotNull(), col), T("node", (("_k", key), ("_l", T("opaque", ("int",))), ("labels", list_of(STR)), ("properties", kind))))

    def rel_value(self, b: Rel) -> Typed:
        props, kind = self._props(b)
        p = b.prefix
        name = self._name(self.graph.types, sorted({t.type for t in b.tables}), c(f"{p}_t"))
        col = F.struct(*[c(f"{p}_{n}").alias(f"_{k}") for n, k in (("dk", "dk"), ("dl", "dl"), ("id", "k"), ("t", "l"), ("sk", "sk"), ("sl", "sl"))], props.alias("properties"), name.alias("type"))
        return Typed(F.when(c(f"{p}_id").isNotNull(), col), self.rel_type(kind))

    def rel_type(self, props: T) -> T:
        key = STR if self.graph.key_type == "string" else INT
        eid = STR if self.graph._text_ids else INT
        code = T("opaque", ("int",))
        return T("rel", tuple(sorted({"_l": code, "_k": eid, "type": STR, "_sl": code, "_sk": key, "_dl": code, "_dk": key, "properties": props}.items())))

    def _rel_list(self, part) -> Typed:
        if isinstance(part, Rel):
            v = self.rel_value(part)
            return Typed(F.array(v.col), list_of(v.type))
        return self.value(part)

    def path_value(self, b: Path) -> Typed:
        nodes, rels = self.path_nodes(b), self.path_rels(b)
        col = F.struct(nodes.col.alias("nodes"), rels.col.alias("rels"))
        return Typed(F.when(nodes.col.isNotNull() & rels.col.isNotNull(), col), T("path", (("nodes", nodes.type), ("rels", rels.type))))

    def path_rels(self, b: Path) -> Typed:
        parts = [self._rel_list(r) for r in b.rels]
        if not parts:
            return Typed(F.when(c(f"{b.nodes[0].prefix}_k").isNotNull(), F.array().cast("array<struct<_k:bigint>>")), list_of(T("rel", (("_k", INT),))))
        t = unify([p.type for p in parts], "a path")
        return Typed(F.concat(*[cast(p, t) for p in parts]), t)

    def path_nodes(self, b: Path) -> Typed:
        """Nodes of fixed hops come with their properties; those inside a
        variable part by identity alone (they show in no column)."""
        if any(not isinstance(r, Rel) for r in b.rels):
            key = STR if self.graph.key_type == "string" else INT
            kind = T("node", (("_k", key), ("_l", T("opaque", ("int",))), ("labels", list_of(STR)), ("properties", T("map", ()))))
            names = F.array(*[F.lit(n) for n in self.graph.labels]).cast("array<string>")
            mk = lambda lab, k: F.struct(k.alias("_k"), lab.alias("_l"), F.array(F.get(names, lab)).alias("labels"), F.struct(F.lit(None).cast("string").alias("")).alias("properties"))
            first = b.nodes[0]
            out = F.array(mk(c(f"{first.prefix}_l"), c(f"{first.prefix}_k")))
            for rel in b.rels:
                hops = self._rel_list(rel).col
                # each hop leads to the end that isn't the node before
                step = lambda acc, r: F.concat(acc, F.array(F.when((F.element_at(acc, -1)["_l"] == r["_sl"]) & (F.element_at(acc, -1)["_k"] == r["_sk"]), mk(r["_dl"], r["_dk"])).otherwise(mk(r["_sl"], r["_sk"]))))
                out = F.aggregate(hops, out, step)
            return Typed(F.when(c(f"{first.prefix}_k").isNotNull(), out), list_of(kind))
        vs = [self.node_value(n) for n in b.nodes]
        t = unify([v.type for v in vs], "a path")
        return Typed(F.when(vs[0].col.isNotNull(), F.array(*[cast(v, t) for v in vs])), list_of(t))

    # -- expressions

    def expr(self, e: A.Expr, scope: Scope) -> Typed:
        return getattr(self, "x_" + type(e).__name__.lower())(e, scope)

    def x_lit(self, e: A.Lit, scope: Scope) -> Typed:
        return M.literal(e.value)

    def x_param(self, e: A.Param, scope: Scope) -> Typed:
        if e.name not in self.params:
            raise BindError(f"missing parameter ${e.name}")
        return M.literal(self.params[e.name])

    def x_var(self, e: A.Var, scope: Scope) -> Typed:
        return self.value(self.lookup(e.name, scope))

    def x_prop(self, e: A.Prop, scope: Scope) -> Typed:
        if isinstance(e.of, A.Var):
            b = self.lookup(e.of.name, scope)
            if isinstance(b, (Node, Rel)):
                props = dict(b.props)
                return Typed(c(f"{b.prefix}.{e.key}"), props[e.key]) if e.key in props else M.null()
        if isinstance(e.of, A.Call) and e.of.name.lower() in ("startnode", "endnode"):
            return self._end_prop(e.of, e.key, scope)
        return self.field_of(self.expr(e.of, scope), e.key)

    def field_of(self, v: Typed, key: str) -> Typed:
        if v.kind == "null":
            return M.null()
        if v.kind in ("node", "rel"):
            kind = v.type.fields["properties"]
            if not kind.args and v.kind == "node" and "labels" in v.type.fields and not self._known_empty(v):
                raise Unsupported("properties of nodes inside a variable-length path")
            v = Typed(v.col["properties"], kind)
        if v.kind == "map":
            return Typed(v.col.getField(key), v.type.fields[key]) if key in v.type.fields else M.null()
        if v.kind == "dmap":
            return Typed(F.try_element_at(v.col, F.lit(key)), v.type.of)
        raise CypherTypeError(f"no properties on {v.kind}")

    def _known_empty(self, v: Typed) -> bool:
        return all(not t.props for t in self.graph.nodes.values())

    def _end_prop(self, call: A.Call, key: str, scope: Scope) -> Typed:
        """A property of an end of a relationship: a join on its key."""
        rel = self._need_rel(call, scope)
        node = self._end_node(rel, "s" if call.name.lower() == "startnode" else "d", {key})
        return Typed(c(f"{node.prefix}.{key}"), dict(node.props)[key]) if key in dict(node.props) else M.null()

    def _need_rel(self, call: A.Call, scope: Scope) -> Rel:
        b = self.lookup(call.args[0].name, scope) if len(call.args) == 1 and isinstance(call.args[0], A.Var) else None
        if not isinstance(b, Rel):
            raise Unsupported(f"{call.name} of anything but a bound relationship")
        return b

    def _end_node(self, rel: Rel, end: str, need: set[str]) -> Node:
        labels = tuple(sorted({t.src_label if end == "s" else t.dst_label for t in rel.tables}))
        prefix = self.fresh("end")
        node, scan = self.scan(prefix, labels, need, ())
        on = (c(f"{rel.prefix}_{end}l") == c(f"{prefix}_l")) & (c(f"{rel.prefix}_{end}k") == c(f"{prefix}_k"))
        self.df = self.df.join(scan, on, "left")
        return node

    def x_listlit(self, e: A.ListLit, scope: Scope) -> Typed:
        return M.list_literal([self.expr(x, scope) for x in e.items])

    def x_maplit(self, e: A.MapLit, scope: Scope) -> Typed:
        return M.map_literal({k: self.expr(x, scope) for k, x in e.items})

    def x_unary(self, e: A.Unary, scope: Scope) -> Typed:
        v = self.expr(e.of, scope)
        if e.op == "NOT":
            return Typed(~M.boolean(v), BOOL)
        if e.op == "-":
            return M.negate(v)
        if v.kind not in ("int", "float", "null"):
            raise CypherTypeError(f"no plus for {v.kind}")
        return v

    def x_binary(self, e: A.Binary, scope: Scope) -> Typed:
        if e.op == "=~":
            raise Unsupported("regular expressions")
        a, b = self.expr(e.left, scope), self.expr(e.right, scope)
        if e.op in ("AND", "OR", "XOR"):
            return M.logic(e.op, a, b)
        if e.op == "IN":
            return M.in_list(a, b)
        if e.op in ("STARTS", "ENDS", "CONTAINS"):
            return M.string_predicate(e.op, a, b)
        return M.arithmetic(e.op, a, b)

    def x_compare(self, e: A.Compare, scope: Scope) -> Typed:
        out, left = None, e.first
        for op, right in e.rest:
            one = self._compare(op, left, right, scope)
            out = one if out is None else Typed(out.col & one.col, BOOL)
            left = right
        return out

    def _compare(self, op: str, a: A.Expr, b: A.Expr, scope: Scope) -> Typed:
        if isinstance(a, A.Var) and isinstance(b, A.Var) and op in ("=", "<>"):
            x, y = self.lookup(a.name, scope), self.lookup(b.name, scope)
            if isinstance(x, Node) and isinstance(y, Node) or isinstance(x, Rel) and isinstance(y, Rel):
                same = _same(x, y)
                return Typed(same if op == "=" else ~same, BOOL)
        return M.compare(op, self.expr(a, scope), self.expr(b, scope))

    def x_isnull(self, e: A.IsNull, scope: Scope) -> Typed:
        if isinstance(e.of, A.Var):
            b = self.lookup(e.of.name, scope)
            if isinstance(b, (Node, Rel)):
                col = c(f"{b.prefix}_{'k' if isinstance(b, Node) else 'id'}")
                return Typed(col.isNotNull() if e.negated else col.isNull(), BOOL)
        v = self.expr(e.of, scope)
        return Typed(v.col.isNotNull() if e.negated else v.col.isNull(), BOOL)

    def x_haslabels(self, e: A.HasLabels, scope: Scope) -> Typed:
        b = self.lookup(e.of.name, scope) if isinstance(e.of, A.Var) else None
        if isinstance(b, Rel):
            codes = [t for t in self.graph.types if all(t == x for x in e.labels)]
            hit = c(f"{b.prefix}_t") == F.lit(self.graph.type_code(codes[0])) if codes else F.lit(False)
            return Typed(F.when(c(f"{b.prefix}_id").isNotNull(), hit), BOOL)
        if isinstance(b, Node):
            return Typed(F.when(c(f"{b.prefix}_k").isNotNull(), self._has(b, e.labels)), BOOL)
        v = self.expr(e.of, scope)
        if v.kind == "null":
            return M.null(BOOL)
        if v.kind == "rel":
            hit = F.lit(True)
            for x in e.labels:
                hit = hit & (v.col["type"] == x)
            return Typed(M.unless_null(hit, v), BOOL)
        if v.kind != "node":
            raise CypherTypeError(f"no labels on {v.kind}")
        hit = F.lit(True)
        for x in e.labels:
            hit = hit & F.array_contains(v.col["labels"], x)
        return Typed(M.unless_null(hit, v), BOOL)

    def _has(self, b: Node, labels) -> Column:
        hit = F.lit(True)
        for x in labels:
            own = c(f"{b.prefix}_l") == self.graph.label_code(x) if x in self.graph.nodes else F.lit(False)
            hit = hit & (own | F.array_contains(c(f"{b.prefix}_labels"), x) if b.has_labels else own)
        return hit

    def x_index(self, e: A.Index, scope: Scope) -> Typed:
        if isinstance(e.at, A.Lit) and isinstance(e.at.value, str):
            return self.x_prop(A.Prop(e.of, e.at.value), scope)
        v, i = self.expr(e.of, scope), self.expr(e.at, scope)
        if "null" in (v.kind, i.kind):
            return M.null(v.type.of if v.kind == "list" else NULL)
        if v.kind == "list":
            if i.kind != "int":
                raise CypherTypeError(f"a list index is an integer, not {i.kind}")
            at = F.when(i.col < 0, i.col).otherwise(i.col + 1)
            at = F.when(F.abs(at) < 2**31, at).cast("int")
            return Typed(F.try_element_at(v.col, at), v.type.of)
        if i.kind == "str" and v.kind == "dmap":
            return Typed(F.try_element_at(v.col, i.col), v.type.of)
        if i.kind == "str" and v.kind in ("map", "node", "rel"):
            if isinstance(i.const, str):
                return self.field_of(v, i.const)
            props = v if v.kind == "map" else Typed(v.col["properties"], v.type.fields["properties"])
            t = unify(list(props.type.fields.values()), "a map read by a computed key")
            out = F.lit(None).cast(ddl(t))
            for k, ft in props.type.args:
                out = F.when(i.col == k, cast(Typed(props.col.getField(k), ft), t)).otherwise(out)
            return Typed(out, t)
        raise CypherTypeError(f"no {v.kind} indexed by {i.kind}")

    def x_slice(self, e: A.Slice, scope: Scope) -> Typed:
        v = self.expr(e.of, scope)
        if v.kind == "null":
            return M.null()
        if v.kind != "list":
            raise CypherTypeError(f"no slice of {v.kind}")
        n = F.size(v.col)

        def bound(x: A.Expr | None, default: Column) -> tuple[Column, list[Typed]]:
            if x is None:
                return default, []
            b = self.expr(x, scope)
            if b.kind not in ("int", "null"):
                raise CypherTypeError(f"a slice bound is an integer, not {b.kind}")
            at = b.col.cast("bigint")
            at = F.when(at < 0, at + n).otherwise(at)
            return F.least(F.greatest(at, F.lit(0)), n.cast("bigint")).cast("int"), [b]

        lo, a = bound(e.lo, F.lit(0))
        hi, b = bound(e.hi, n)
        out = F.slice(v.col, lo + 1, F.greatest(hi - lo, F.lit(0)))
        return Typed(M.unless_null(out, v, *a, *b), v.type)

    def x_case(self, e: A.Case, scope: Scope) -> Typed:
        arms = []
        subject = self.expr(e.subject, scope) if e.subject is not None else None
        for when, then in e.arms:
            w = self.expr(when, scope)
            arms.append((M.boolean(w) if subject is None else M.eq(subject, w), self.expr(then, scope)))
        default = self.expr(e.default, scope) if e.default is not None else M.null()
        t = unify([v.type for _, v in arms] + [default.type], "CASE")
        out = None
        for when, then in arms:
            out = F.when(when, cast(then, t)) if out is None else out.when(when, cast(then, t))
        return Typed(out.otherwise(cast(default, t)), t)

    def x_call(self, e: A.Call, scope: Scope) -> Typed:
        name = e.name.lower()
        if name in AGGREGATES:
            raise BindError(f"{e.name} can't stand here: aggregates belong into WITH and RETURN")
        if name not in FUNCTIONS:
            raise BindError(f"unknown function {e.name}" + did_you_mean(name, [*FUNCTIONS, *AGGREGATES]))
        f = FUNCTIONS[name]
        if not f.least <= len(e.args) <= f.most:
            raise BindError(f"{e.name} takes {f.least} to {f.most} arguments, not {len(e.args)}")
        if e.distinct:
            raise BindError(f"DISTINCT belongs to aggregates, not to {e.name}")
        if len(e.args) == 1 and isinstance(e.args[0], A.Var):
            special = self._of_entity(name, e, self.lookup(e.args[0].name, scope))
            if special is not None:
                return special
        args = [self.expr(a, scope) for a in e.args]
        if name in ("nodes", "relationships") and args[0].kind in ("path", "null"):
            if args[0].kind == "null":
                return M.null()
            field_name = "nodes" if name == "nodes" else "rels"
            return Typed(args[0].col[field_name], args[0].type.fields[field_name])
        if name in ("startnode", "endnode"):
            if args[0].kind == "null":
                return M.null()
            node = self._end_node(self._need_rel(e, scope), name[0].replace("e", "d"), {k for t in self.graph.nodes.values() for k in t.props} | {"@labels"})
            return self.node_value(node)
        return f.run(args)

    def _of_entity(self, name: str, e: A.Call, b) -> Typed | None:
        if isinstance(b, Node) and name == "labels":
            return Typed(F.when(c(f"{b.prefix}_k").isNotNull(), self.label_names(b)), list_of(STR))
        if isinstance(b, Rel) and name == "type":
            named = self._name(self.graph.types, sorted({t.type for t in b.tables}), c(f"{b.prefix}_t"))
            return Typed(F.when(c(f"{b.prefix}_id").isNotNull(), named), STR)
        if isinstance(b, Path):
            if name == "length":
                fixed = sum(isinstance(r, Rel) for r in b.rels)
                out = F.lit(fixed).cast("bigint")
                for r in b.rels:
                    if not isinstance(r, Rel):
                        out = out + length_of(self.value(r)).col
                first = c(f"{b.nodes[0].prefix}_k")
                return Typed(F.when(first.isNotNull(), out), INT)
            if name == "nodes":
                return self.path_nodes(b)
            if name == "relationships":
                return self.path_rels(b)
        return None

    def _local(self, scope: Scope, **new: Typed) -> Scope:
        return {**scope, **new}

    def _list(self, e: A.Expr, scope: Scope, what: str) -> Typed:
        v = self.expr(e, scope)
        if v.kind not in ("list", "null"):
            raise CypherTypeError(f"{what} needs a list, not {v.kind}")
        return Typed(v.col.cast("array<string>"), list_of(NULL), None) if v.kind == "null" else v

    def x_listcomp(self, e: A.ListComp, scope: Scope) -> Typed:
        v = self._list(e.of, scope, "a list comprehension")
        of, out = v.type.of, v.col
        if e.where is not None:
            out = F.filter(out, lambda x: M.boolean(self.expr(e.where, self._local(scope, **{e.var: Typed(x, of)}))))
        if e.result is None:
            return Typed(out, v.type)
        kinds: list[T] = []

        def each(x: Column) -> Column:
            r = self.expr(e.result, self._local(scope, **{e.var: Typed(x, of)}))
            kinds.append(r.type)
            return r.col if r.kind != "null" else r.col.cast("string")

        out = F.transform(out, each)
        return Typed(out, list_of(kinds[0]))

    def x_quantifier(self, e: A.Quantifier, scope: Scope) -> Typed:
        v = self._list(e.of, scope, e.kind)
        of = v.type.of
        test = lambda x: M.boolean(self.expr(e.where, self._local(scope, **{e.var: Typed(x, of)})))
        if e.kind == "all":
            return Typed(F.forall(v.col, test), BOOL)
        if e.kind == "any":
            return Typed(F.exists(v.col, test), BOOL)
        if e.kind == "none":
            return Typed(~F.exists(v.col, test), BOOL)
        sure = F.size(F.filter(v.col, test))
        open_ = F.exists(v.col, lambda x: test(x).isNull())
        out = F.when(v.col.isNull(), F.lit(None).cast("boolean")).when(sure > 1, False).when(open_, F.lit(None).cast("boolean")).otherwise(sure == 1)
        return Typed(out, BOOL)

    def x_reduce(self, e: A.Reduce, scope: Scope) -> Typed:
        v = self._list(e.of, scope, "reduce")
        init = self.expr(e.init, scope)
        t = init.type
        for _ in range(3):  # the accumulator's type may widen
            seen: list[T] = []

            out = F.aggregate(v.col, cast(init, t), self._fold_step(e, scope, v.type.of, t, seen))
            if seen[0] == t:
                return Typed(out, t)
            t = seen[0]
        raise Unsupported("reduce with an accumulator of changing type")

    def _fold_step(self, e: A.Reduce, scope: Scope, of: T, t: T, seen: list[T]) -> Callable[[Column, Column], Column]:
        """One step of a fold whose accumulator has the type *t*; *seen* gets the type it should have."""

        def step(acc: Column, x: Column) -> Column:
            r = self.expr(e.result, self._local(scope, **{e.acc: Typed(acc, t), e.var: Typed(x, of)}))
            both = unify([t, r.type], "reduce")
            seen.append(both)
            return cast(r, both)

        return step

    # -- pattern expressions: joined to the frame, read as a column

    def x_patternpred(self, e: A.PatternPred, scope: Scope) -> Typed:
        sub = self._predicate(e, scope)
        flag = self.fresh("exists")
        ids = sub.hole_columns()
        found = sub.df.select(*[c(i) for i in ids]).distinct().withColumn(flag, F.lit(True)) if ids else sub.df.select(F.lit(True).alias(flag)).limit(1)
        self.df = self.frame().join(found, _all([on for on in sub.conditions(scope)]), "left")
        return Typed(c(flag).isNotNull(), BOOL)

    def _predicate(self, e: A.PatternPred, scope: Scope) -> Pattern:
        for part in (*e.path.nodes, *e.path.rels):
            if part.var and part.var not in scope:
                raise BindError(f"a pattern predicate can't introduce {part.var}")
        if any(r.hops for r in e.path.rels):
            raise Unsupported("variable-length pattern predicates")
        p = Pattern(self, scope)
        p.rels = list(e.path.rels)
        p.add(e.path)
        return p

    def x_patterncomp(self, e: A.PatternComp, scope: Scope) -> Typed:
        p, as_set, self.as_set = Pattern(self, scope), self.as_set, False
        p.rels = list(e.path.rels)
        p.add(e.path)
        self.as_set = as_set
        inner = p.inner_scope()
        used = [x for x in A.walk(e) if isinstance(x, A.Var) and x.name in scope]
        outer_names = sorted({x.name for x in used if not isinstance(scope[x.name], Typed)})
        if any(isinstance(scope[x.name], Typed) for x in used):
            raise Unsupported("a pattern comprehension that reads a list element")
        carry = sorted({col for n in outer_names for col in scope[n].columns()})
        ids = p.hole_columns()
        saved = self.df
        if carry:
            keys = self.frame().select(*[c(x) for x in carry]).distinct()
            self.df = keys.join(p.df, _all(p.conditions(scope)))
        else:
            self.df = p.df if not ids else self.frame().select(*[c(x) for n in p.holes for x in _ids(scope[n])]).distinct().join(p.df, _all(p.conditions(scope)))
        both = {**scope, **inner}
        if e.where is not None:
            self.filter(e.where, both)
        result = self.expr(e.result, both)
        group = carry or sorted({x for n in p.holes for x in _ids(scope[n])})
        out = self.fresh("list")
        listed = F.transform(F.collect_list(F.struct(result.col.alias("v"))), lambda x: x["v"]).alias(out)
        grouped = self.df.groupBy(*[c(g) for g in group]).agg(listed) if group else self.df.agg(listed)
        renamed = {g: self.fresh("by") for g in group}
        grouped = grouped.select(*[c(g).alias(n) for g, n in renamed.items()], c(out))
        self.df = saved if saved is not None else self.frame()
        self.df = self.df.join(grouped, _all([c(g).eqNullSafe(c(n)) for g, n in renamed.items()]), "left").drop(*renamed.values())
        return Typed(F.coalesce(c(out), F.array().cast(f"array<{ddl(result.type)}>")), list_of(result.type))

    # -- filtering

    def filter(self, where: A.Expr | None, scope: Scope) -> None:
        """Keep rows for which *where* is true; pattern predicates among its
        conjuncts become semi and anti joins."""
        for e in _conjuncts(where):
            negated = isinstance(e, A.Unary) and e.op == "NOT" and isinstance(e.of, A.PatternPred)
            if isinstance(e, A.PatternPred) or negated:
                sub = self._predicate(e.of if negated else e, scope)
                self.df = self.frame().join(sub.df, _all(sub.conditions(scope)), "left_anti" if negated else "left_semi")
            else:
                cond = M.boolean(self.expr(e, scope))
                self.df = self.frame().filter(cond)

    # -- MATCH

    def match(self, m: A.Match) -> None:
        outer_graph = self.graph
        if m.at is not None:
            ref = self.constant(m.at)
            if self.at is None or not isinstance(ref, str):
                raise Unsupported("AT needs a versioned session and the name of a version")
            self.graph = self.at(ref)
        try:
            self._match(m)
        finally:
            self.graph = outer_graph

    def _match(self, m: A.Match) -> None:
        outer = dict(self.scope)
        p = Pattern(self, outer, optional=m.optional)
        p.rels = [r for path in m.paths for r in path.rels]
        p.add(*m.paths)
        inner = p.inner_scope()
        if not m.optional:
            if p.df is not None:
                self.df = p.df if self.df is None else self.df.join(p.df, _all(p.conditions(outer)))
            else:
                for on in p.conditions(outer):
                    self.df = self.frame().filter(on)
            self.scope = {**outer, **inner}
            self.filter(m.where, self.scope)
            return
        # the condition is part of the match: what reads new variables alone filters the
        # pattern, the rest goes into the join
        saved, on = self.frame(), p.conditions(outer)
        both = {**outer, **inner}
        self.df = p.df if p.df is not None else self.spark.range(1).select()
        sub_scope = {**p.hole_scope(), **inner}
        for e in _conjuncts(m.where):
            names = {x.name for x in A.walk(e) if isinstance(x, A.Var)} | {part.var for x in A.walk(e) if isinstance(x, A.Path) for part in (*x.nodes, *x.rels) if part.var}
            patterns = any(isinstance(x, (A.PatternPred, A.PatternComp)) for x in A.walk(e))
            if patterns and (names - set(both) or any(n in outer and n not in p.holes for n in names)):
                raise Unsupported("a pattern in OPTIONAL MATCH ... WHERE that reads other variables")
            if patterns or not (names & set(outer)):
                self.filter(e, sub_scope)
            else:
                on.append(M.boolean(self.expr(e, both)))
        self.df = saved.join(self.df, _all(on), "left")
        self.scope = both

    # -- UNWIND

    def unwind(self, u: A.Unwind) -> None:
        if u.var in self.scope:
            raise BindError(f"variable {u.var} is already bound")
        v = self.expr(u.of, self.scope)
        if v.kind == "null":
            v = Typed(F.array().cast("array<string>"), list_of(NULL))
        if v.kind != "list":
            raise CypherTypeError(f"UNWIND needs a list, not {v.kind}")
        col = self.fresh(u.var)
        self.df = self.frame().select("*", F.explode(v.col).alias(col))
        self.scope = {**self.scope, u.var: Value(col, v.type.of)}

    # -- CALL

    def call(self, call: A.CallProc) -> None:
        short = call.name.rpartition(".")[2].lower()
        proc = self.procedures.get(short)
        if proc is None:
            raise BindError(f"unknown procedure {call.name}" + did_you_mean(short, self.procedures))
        args = [] if call.args is None else list(call.args)
        if not proc.least <= len(args) <= proc.most:
            raise BindError(f"{call.name} takes {proc.least} to {proc.most} arguments, not {len(args)}")
        correlated = any(isinstance(x, A.Var) for a in args for x in A.walk(a))
        if correlated:
            typed = [self.expr(a, self.scope) for a in args]
            names = [self.fresh("arg") for _ in args]
            self.df = self.frame().select("*", *[t.col.alias(n) for t, n in zip(typed, names)])
            found = None
            tuples = self.df.select(*[c(n) for n in names]).distinct().limit(1001).collect()
            if len(tuples) > 1000:
                raise Unsupported("a call with more than 1000 different argument lists")
            for row in tuples:
                part = proc.run(*row).select("*", *[F.lit(v).alias(n + "v") for v, n in zip(row, names)])
                found = part if found is None else found.unionByName(part)
            found = proc.run(*[None] * len(args)).limit(0).select("*", *[F.lit(None).alias(n + "v") for n in names]) if found is None else found
            on = [c(n).eqNullSafe(c(n + "v")) for n in names]
        else:
            found, on = proc.run(*[self.constant(a) for a in args]), []
        columns = found.columns if not on else found.columns[: -len(args)]
        wanted = call.yields if call.yields is not None else [(n, n) for n in columns]
        renamed, scope = [], {}
        for name, alias in wanted:
            if name not in columns:
                raise BindError(f"{call.name} yields no {name}" + did_you_mean(name, columns))
            if alias in self.scope or alias in scope:
                raise BindError(f"variable {alias} is already bound")
            col = self.fresh(alias)
            renamed.append(c(name).alias(col))
            kind = proc.types.get(name) or of_spark(found.schema[name].dataType)
            scope[alias] = Value(col, kind)
        found = found.select(*renamed, *[c(n + "v") for n in names] if on else [])
        self.df = found if self.df is None and not on else self.frame().join(found, _all(on))
        self.scope = {**self.scope, **scope}
        if call.where is not None:
            self.filter(call.where, self.scope)

    # -- WITH, RETURN

    def constant(self, e: A.Expr):
        """The value of an expression without variables."""
        if isinstance(e, A.Lit):
            return e.value
        if isinstance(e, A.Param):
            if e.name not in self.params:
                raise BindError(f"missing parameter ${e.name}")
            return self.params[e.name]
        if any(isinstance(x, (A.Var, A.PatternPred, A.PatternComp)) for x in A.walk(e)):
            raise BindError("a constant is needed here")
        return self.spark.range(1).select(self.expr(e, {}).col.alias("v")).head()[0]

    def _count(self, e: A.Expr | None, what: str) -> int | None:
        if e is None:
            return None
        n = self.constant(e)
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise CypherTypeError(f"{what} needs a whole number, not negative")
        return n

    def project(self, p: A.Project) -> None:
        items = list(p.items)
        if p.star:
            if not self.scope and p.final:
                raise BindError("RETURN * without variables")
            items = [A.Item(A.Var(n), n, n) for n in sorted(self.scope)] + items
        names = [i.alias or (i.expr.name if isinstance(i.expr, A.Var) else i.text) for i in items]
        if len(set(names)) < len(names):
            raise BindError("two columns of the same name")
        self.frame()
        aggregated = any(_aggregates(i.expr) for i in items)
        old = dict(self.scope)
        if aggregated:
            scope, resolve = self._aggregate(items, names, p.order)
        else:
            scope = {}
            for item, name in zip(items, names):
                scope[name] = self._bind(item.expr, old, name)
            resolve = lambda e, s: self.expr(e, s)
        if p.distinct:
            keys = [k for n in names for k in _identity(scope[n])]
            kept = list(dict.fromkeys(x for n in names for x in scope[n].columns()))
            self.df = self.df.select(*[c(x) for x in kept])
            self.df = self.df.dropDuplicates(list(dict.fromkeys(keys))) if keys else self.df.distinct()
        if p.order:
            by_text = {i.expr: n for i, n in zip(items, names)}
            visible = dict(scope) if aggregated or p.distinct else {**old, **scope}
            keys = []
            for o in p.order:
                if o.expr in by_text and not isinstance(o.expr, A.Var):
                    v = self.value(scope[by_text[o.expr]])
                elif isinstance(o.expr, A.Var) and o.expr.name not in visible and o.expr in by_text:
                    v = self.value(scope[by_text[o.expr]])
                else:
                    if (aggregated or p.distinct) and not _aggregates(o.expr):
                        e = _replaced(o.expr, by_text)
                        v = self.expr(e, visible)
                    else:
                        v = resolve(o.expr, visible)
                keys.append(_sort_key(v, o.descending))
            self.df = self.df.orderBy(*keys)
        skip, limit = self._count(p.skip, "SKIP"), self._count(p.limit, "LIMIT")
        if skip:
            self.df = self.df.offset(skip)
        if limit is not None:
            self.df = self.df.limit(limit)
        if p.final:
            self.df = self.df.select(*[self.value(scope[n]).col.alias(n) for n in names])
            self.out_types = {n: self.value(scope[n]).type for n in names}
            self.scope = {}
            return
        kept = list(dict.fromkeys(x for n in names for x in scope[n].columns()))
        self.df = self.df.select(*[c(x) for x in kept])
        self.scope = scope
        if p.where is not None:
            self.filter(p.where, scope)

    def _bind(self, e: A.Expr, scope: Scope, name: str):
        """A variable stays what it is; anything else becomes a column."""
        if isinstance(e, A.Var):
            b = self.lookup(e.name, scope)
            if not isinstance(b, Path):
                return b
        v = self.expr(e, scope)
        col = self.fresh(name)
        self.df = self.df.withColumn(col, v.col if v.kind != "null" else v.col.cast("string"))
        return Value(col, v.type)

    def _aggregate(self, items: list[A.Item], names: list[str], order) -> tuple[Scope, Callable]:
        old = dict(self.scope)
        keys: dict[A.Expr, object] = {}
        for item, name in zip(items, names):
            if not _aggregates(item.expr):
                keys[item.expr] = self._bind(item.expr, old, name)
        calls: dict[A.Expr, tuple[str, T]] = {}
        aggs: list[Column] = []

        def extract(e: A.Expr) -> None:
            if isinstance(e, A.Call) and e.name.lower() in AGGREGATES:
                if e not in calls:
                    if any(isinstance(x, A.Call) and x.name.lower() in AGGREGATES for a in e.args for x in A.walk(a)):
                        raise BindError("an aggregate within an aggregate")
                    if len(e.args) != (0 if e.star else 1):
                        raise BindError(f"{e.name} takes one argument")
                    col, out = self.fresh("agg"), self._agg_column(e, old)
                    aggs.append(out.col.alias(col))
                    calls[e] = (col, out.type)
                return
            for x in A.children(e):
                if isinstance(x, A.Expr):
                    extract(x)

        for e in [i.expr for i in items] + [o.expr for o in order]:
            extract(e)
        group = list(dict.fromkeys(x for b in keys.values() for x in _identity(b)))
        # properties depend on the identity: as grouping columns they keep the aggregation a hash one
        carried = list(dict.fromkeys(x for b in keys.values() for x in b.columns() if x not in group))
        by = [c(x) for x in [*group, *carried]]
        self.df = self.df.groupBy(*by).agg(*aggs) if by else self.df.agg(*aggs)
        key_scope = {e.name: b for e, b in keys.items() if isinstance(e, A.Var)}

        def resolve(e: A.Expr, scope: Scope) -> Typed:
            inner = dict(scope)
            inner.update({n: b for n, b in key_scope.items() if n not in inner})
            e = self._placed(e, keys, calls, inner)
            return self.expr(e, inner)

        scope: Scope = {}
        for item, name in zip(items, names):
            if item.expr in keys:
                scope[name] = keys[item.expr]
                continue
            e = self._placed(item.expr, keys, calls, inner := dict(key_scope))
            try:
                scope[name] = self._bind(e, inner, name)
            except BindError as err:
                raise BindError(f"{err}; beside aggregates only grouping columns can be read") from None
        return scope, resolve

    def _placed(self, e: A.Expr, keys: dict, calls: dict, scope: Scope) -> A.Expr:
        """*e* with aggregates and grouping expressions as variables."""
        if e in calls:
            col, t = calls[e]
            scope[col] = Value(col, t)
            return A.Var(col)
        if e in keys and not isinstance(e, (A.Var, A.Lit)):
            name = "key " + str(id(keys[e]))
            scope[name] = keys[e]
            return A.Var(name)
        return _rebuilt(e, lambda x: self._placed(x, keys, calls, scope))

    def _agg_column(self, e: A.Call, scope: Scope) -> Typed:
        name = e.name.lower()
        if e.star:
            return Typed(F.count(F.lit(1)), INT)
        arg = e.args[0]
        if name == "count" and isinstance(arg, A.Var):
            b = self.lookup(arg.name, scope)
            if isinstance(b, (Node, Rel)):
                ids = [c(x) for x in _ids(b)]
                return Typed(F.count_distinct(*ids) if e.distinct else F.count(ids[-1]), INT)
        v = self.expr(arg, scope)
        if name == "count":
            if v.kind == "null":
                return Typed(F.count(v.col), INT)
            col = F.struct(v.col["_l"], v.col["_k"]) if v.kind in ("node", "rel") else v.col
            return Typed(F.count_distinct(F.when(v.col.isNotNull(), col)) if e.distinct else F.count(v.col), INT)
        if name == "collect":
            t = v.type if v.kind != "null" else STR
            col = v.col if v.kind != "null" else v.col.cast("string")
            return Typed(F.collect_set(col) if e.distinct else F.collect_list(col), list_of(t))
        if name in ("min", "max"):
            return Typed((F.min if name == "min" else F.max)(v.col), v.type)
        if v.kind == "null":
            return Typed(F.coalesce(F.sum(v.col.cast("bigint")), F.lit(0).cast("bigint")), INT) if name == "sum" else Typed(F.avg(v.col.cast("double")), FLOAT)
        if v.kind not in ("int", "float"):
            raise CypherTypeError(f"{name} takes numbers, not {v.kind}")
        if name == "sum":
            total = F.sum_distinct(v.col) if e.distinct else F.sum(v.col)
            return Typed(F.coalesce(total, F.lit(0).cast("bigint" if v.kind == "int" else "double")), v.type)
        x = v.col.cast("double")
        return Typed(F.sum_distinct(x) / F.nullif(F.count_distinct(x), F.lit(0)) if e.distinct else F.avg(x), FLOAT)

    # -- scans

    def scan(self, prefix: str, labels, need: set[str], must: tuple[str, ...]) -> tuple[Node, DataFrame]:
        known = self.graph.node_props(list(labels))
        props = known if ALL in need else {k: known[k] for k in sorted(need) if k in known}
        with_labels = self.graph.secondary and bool(need & {ALL, "@labels"})
        node = Node(prefix, tuple(labels), tuple(props.items()), with_labels)
        return node, self.graph.scan_nodes(list(labels), prefix, props, with_labels, must)


# -- patterns ----------------------------------------------------------------


class Pattern:
    """The paths of one clause as a frame of their own.

    Variables bound before are holes: the pattern has their identity from its
    edge tables, under fresh names, and ``conditions`` ties them to the frame.
    """

    def __init__(self, compiler: Compiler, outer: Scope, optional: bool = False) -> None:
        self.k = compiler
        self.graph = compiler.graph
        self.outer = outer
        self.optional = optional
        self.df: DataFrame | None = None
        self.nodes: dict[str, Node] = {}  # by variable, or by position for nodes without a name
        self.new: dict[str, object] = {}
        self.holes: dict[str, object] = {}
        self.extra: list[Column] = []  # conditions that need the frame
        self.used: list = []  # relationships of the clause, for uniqueness
        self.anonymous = itertools.count()
        self.whole = False  # the path being added is read with all that its parts have
        self.named = False  # it has a name
        self.rels: list[A.RelPat] = []  # all relationships of the clause

    # -- results

    def inner_scope(self) -> Scope:
        return dict(self.new)

    def hole_scope(self) -> Scope:
        return dict(self.holes)

    def hole_columns(self) -> list[str]:
        return [x for b in self.holes.values() for x in _ids(b)]

    def conditions(self, scope: Scope) -> list[Column]:
        out = []
        for name, hole in self.holes.items():
            b = scope[name]
            mine, theirs = _ids(hole), _ids(b)
            if isinstance(b, Node) and len(set(hole.labels)) == 1 and hole.labels == b.labels:
                mine, theirs = mine[1:], theirs[1:]  # one label on both sides: keys decide
            out += [c(x) == c(y) for x, y in zip(theirs, mine)]
        return out + self.extra

    # -- building

    def _join(self, df: DataFrame, on: list[Column]) -> None:
        if self.df is None:
            self.df = df
            for x in on:
                self.df = self.df.filter(x)
        else:
            self.df = self.df.join(df, _all(on)) if on else self.df.crossJoin(df)

    def add(self, *paths: A.Path) -> None:
        order = self._order(paths)
        if order is not None:
            self._add_in_order(paths, order)
            return
        for path in paths:
            self._add(path)

    def _check(self, path: A.Path) -> None:
        g = self.graph
        for n in path.nodes:
            for label in n.labels:
                g.check_label(label)
        for r in path.rels:
            for t in r.types:
                g.check_type(t)
        if path.var and (path.var in self.outer or path.var in self.new):
            raise BindError(f"variable {path.var} is already bound")

    def _enter(self, path: A.Path) -> None:
        self.named = path.var is not None
        self.whole = bool(path.var and self.k.needs and {ALL} & (self.k.needs.get(path.var) | self.k.needs.get(ALL)))

    def _add(self, path: A.Path) -> None:
        self._check(path)
        bound_nodes: list[Node] = []
        bound_rels: list = []
        first = self._node_name(path.nodes[0])
        self._enter(path)
        if not path.rels:
            bound_nodes.append(self._alone(first, path.nodes[0]))
        else:
            for i, rel in enumerate(path.rels):
                a, b = path.nodes[i], path.nodes[i + 1]
                na = first if i == 0 else nb  # noqa: F821
                nb = self._node_name(b)
                bound_rels.append(self._hop(na, a, rel, nb, b))
                if i == 0:
                    bound_nodes.append(self.outer.get(na, self.nodes[na]))
                bound_nodes.append(self.outer.get(nb, self.nodes[nb]))
        self.whole = False
        if path.var:
            self.new[path.var] = Path(tuple(bound_nodes), tuple(bound_rels), self.k.fresh(path.var))

    def _add_in_order(self, paths: tuple[A.Path, ...], order: list[tuple[int, int]]) -> None:
        for path in paths:
            self._check(path)
        names = [[self._node_name(n) for n in path.nodes] for path in paths]
        rels: dict[tuple[int, int], Rel] = {}
        for i, j in order:
            path = paths[i]
            self._enter(path)
            rels[i, j] = self._hop(names[i][j], path.nodes[j], path.rels[j], names[i][j + 1], path.nodes[j + 1])
        written: list[str | None] = []
        for i, path in enumerate(paths):
            self._enter(path)
            if not path.rels:
                self._alone(names[i][0], path.nodes[0])
            if path.var:
                bound = tuple(self.outer.get(n) or self.nodes[n] for n in names[i])
                self.new[path.var] = Path(bound, tuple(rels[i, j] for j in range(len(path.rels))), self.k.fresh(path.var))
            hops = zip(path.nodes[1:], path.rels)
            written += [path.nodes[0].var, *[x.var for hop in hops for x in hop], path.var]
        self.whole = False
        self.new = {n: self.new[n] for n in dict.fromkeys(written) if n in self.new}

    def _order(self, paths: tuple[A.Path, ...]) -> list[tuple[int, int]] | None:
        """The hops, by path and place, in an order that multiplies rows less
        often than the written one; None if there is none.

        A hop multiplies rows if it leads to a new node from one that neither
        has just one such relationship nor is the key of the rows so far: two
        customers' suppliers in one nation are all pairs of them.  A hop between
        two nodes in the frame takes that back.  By this alone rows stay within
        the largest table where that is possible, whatever the sizes.
        """
        hops = [(i, j) for i, path in enumerate(paths) for j in range(len(path.rels))]
        if len(hops) < 3 or not self._any_order(paths):
            return None
        ends: dict[tuple[int, int], tuple] = {}
        once: dict[tuple[int, int], set] = {}  # ends that have one relationship at most
        for i, j in hops:
            a, rel, b = paths[i].nodes[j], paths[i].rels[j], paths[i].nodes[j + 1]
            na, nb = ends[i, j] = a.var or (i, j), b.var or (i, j + 1)
            forward, backward = self._tables(rel, a, b, a.var or "", b.var or "")
            once[i, j] = set()
            if len(forward) + len(backward) == 1:
                by_end = {"src": na, "dst": nb} if forward else {"src": nb, "dst": na}
                once[i, j] = {by_end[end] for end in (forward or backward)[0].once}

        def kind(hop: tuple[int, int], bound: set, keys: set) -> int:
            """0: between bound nodes, 1: one relationship a row, 2: from the key, 3: all pairs, 4: unconnected."""
            near = bound & set(ends[hop])
            if bound >= set(ends[hop]):
                return 0
            return 4 if not near else 1 if near & once[hop] else 2 if near & keys else 3

        def weighed(first: list[tuple[int, int]]) -> tuple[tuple[int, int], list[tuple[int, int]]]:
            """*first*, then always the hop that costs least; the most that rows
            are multiplied at a time, and how often they are."""
            order, bound, keys, now, most, times = first[:1], set(ends[first[0]]), once[first[0]], 0, 0, 0
            left = [hop for hop in hops if hop != first[0]]
            while left:
                hop = first[len(order)] if len(order) < len(first) else min(left, key=lambda h: kind(h, bound, keys))
                k, near = kind(hop, bound, keys), bound & set(ends[hop])
                if k == 0:
                    now, keys = max(0, now - 1), keys if once[hop] else set()
                elif k == 1:
                    keys = keys | once[hop] if near & keys else keys
                elif k == 2:
                    keys = once[hop]
                else:
                    now, keys, times = now + 1, set(), times + 1
                most, bound = max(most, now), bound | set(ends[hop])
                order.append(hop)
                left.remove(hop)
            return (most, times), order

        cost, order = min((weighed([hop]) for hop in hops), key=lambda x: x[0])
        return order if cost < weighed(hops)[0] else None

    def _any_order(self, paths: tuple[A.Path, ...]) -> bool:
        """Nothing in the paths depends on what was added before it."""
        nodes, rels = ([x for path in paths for x in parts(path)] for parts in (lambda p: p.nodes, lambda p: p.rels))
        single = [x.var for x in (*rels, *paths) if x.var]
        if len(set(single)) < len(single) or set(single) & {n.var for n in nodes} or any(r.hops is not None for r in rels):
            return False
        maps = [x.props for x in (*nodes, *rels) if x.props is not None]
        return all(isinstance(m, A.MapLit) and not any(isinstance(x, A.Path) or isinstance(x, A.Var) and x.name not in self.outer for x in A.walk(m)) for m in maps)

    def _node_name(self, n: A.NodePat) -> str:
        if n.var is None:
            return f" {next(self.anonymous)}"
        if n.var in self.new and not isinstance(self.new[n.var], Node):
            raise BindError(f"{n.var} is no node")
        if n.var in self.outer and not isinstance(self.outer[n.var], Node):
            b = self.outer[n.var]
            if isinstance(b, Value) and b.type.kind == "node":
                raise Unsupported(f"a pattern from {n.var}, which comes out of a list")
            if isinstance(b, (Value, Typed)) and b.type.kind == "null":
                raise Unsupported(f"a pattern from {n.var}, which is null")
            raise BindError(f"{n.var} is no node")
        return n.var

    def _need(self, n: A.NodePat | A.RelPat) -> set[str]:
        need = set(self.k.needs.get(n.var)) if n.var and self.k.needs else set()
        if self.whole or n.var and self.k.needs and self.k.needs.get(ALL):
            need.add(ALL)
        if isinstance(n.props, A.MapLit):
            need |= {k for k, _ in n.props.items}
        elif isinstance(n.props, A.Param):
            value = self.k.params.get(n.props.name)
            if n.props.name not in self.k.params:
                raise BindError(f"missing parameter ${n.props.name}")
            need |= set(value) if isinstance(value, dict) else set()
        return need

    def _candidates(self, labels: tuple[str, ...]) -> list[str]:
        """Primary labels that nodes with all *labels* can have."""
        g = self.graph
        out = []
        for name, t in g.nodes.items():
            others = [x for x in labels if x != name]
            if not others or t.has_labels:
                out.append(name)
        return out

    def _alone(self, name: str, n: A.NodePat) -> Node:
        if name in self.nodes:
            self._require(name, n)
            return self.nodes[name]
        if name in self.outer:
            b = self.outer[name]
            self.extra += self._label_conditions(b, n.labels) + self._prop_conditions(b, n.props)
            self.extra.append(c(f"{b.prefix}_k").isNotNull())
            return b
        prefix = self.k.fresh(n.var or "n")
        node, scan = self.k.scan(prefix, self._candidates(n.labels), self._need(n), n.labels)
        self._join(scan, [])
        self._remember(name, n, node)
        for cond in self._prop_conditions(node, n.props):
            self._filter_or_defer(cond, n.props)
        return node

    def _remember(self, name: str, n: A.NodePat, node: Node) -> None:
        self.nodes[name] = node
        if name in self.outer:
            self.holes[name] = node
        elif n.var:
            self.new[n.var] = node

    def _filter_or_defer(self, cond: Column, props: A.Expr | None) -> None:
        """A condition that reads variables of the frame waits for the join."""
        reads = props is not None and any(isinstance(x, A.Var) and x.name in self.outer for x in A.walk(props))
        if reads:
            self.extra.append(cond)
        else:
            self.df = self.df.filter(cond)

    def _require(self, name: str, n: A.NodePat) -> None:
        """More labels or properties for a node that is in the frame."""
        node = self.nodes[name]
        if n.labels or n.props is not None:
            if name in self.holes:
                b = self.outer[name]
                self.extra += self._label_conditions(b, n.labels) + self._prop_conditions(b, n.props)
                return
            for cond in self._label_conditions(node, n.labels) + self._prop_conditions(node, n.props):
                self._filter_or_defer(cond, n.props)

    def _label_conditions(self, b: Node, labels: tuple[str, ...]) -> list[Column]:
        open_ = [x for x in labels if b.labels != (x,)]
        return [self.k._has(b, open_)] if open_ else []

    def _prop_conditions(self, b, props: A.Expr | None) -> list[Column]:
        if props is None:
            return []
        if isinstance(props, A.Param):
            value = self.k.params.get(props.name)
            if not isinstance(value, dict):
                return [F.lit(False)]
            pairs = [(k, M.literal(v)) for k, v in value.items()]
        else:
            scope = {**self.outer, **self.new}
            pairs = [(k, self.k.expr(v, scope)) for k, v in props.items]
        have = dict(b.props)
        return [M.eq(Typed(c(f"{b.prefix}.{k}"), have[k]) if k in have else M.null(), v) for k, v in pairs]

    # -- hops

    def _tables(self, rel: A.RelPat, a: A.NodePat, b: A.NodePat, na: str, nb: str) -> tuple[list[RelTable], list[RelTable]]:
        """Edge tables that can serve forwards and backwards."""
        near, far = (self._possible(n, x) for n, x in ((na, a), (nb, b)))
        every = [t for t in self.graph.rels if not rel.types or t.type in rel.types]
        forward = [t for t in every if t.src_label in near and t.dst_label in far] if rel.direction != "in" else []
        backward = [t for t in every if t.dst_label in near and t.src_label in far] if rel.direction != "out" else []
        return forward, backward

    def _possible(self, name: str, n: A.NodePat) -> set[str]:
        out = set(self._candidates(n.labels))
        if name in self.nodes:
            out &= set(self.nodes[name].labels)
        elif name in self.outer:
            out &= set(self.outer[name].labels)
        return out

    def _oriented(self, prefix: str, forward: list[RelTable], backward: list[RelTable], props: dict[str, T]) -> DataFrame:
        """Edges with ``_n_l, _n_k`` (the near end) and ``_f_l, _f_k`` (the far one).
        A loop matched in both directions counts once."""
        both = bool(forward) and bool(backward)

        def turned(tables: list[RelTable], near: str, far: str, loops: bool) -> DataFrame:
            df = self.graph.scan_rels(tables, prefix, props)
            if not loops:
                df = df.filter((c(f"{prefix}_sl") != c(f"{prefix}_dl")) | (c(f"{prefix}_sk") != c(f"{prefix}_dk")))
            return df.select("*", *[c(f"{prefix}_{end}{x}").alias(f"{prefix}_{to}_{x}") for end, to in ((near, "n"), (far, "f")) for x in "lk"])

        if not both:
            return turned(forward, "s", "d", True) if forward or not backward else turned(backward, "d", "s", True)
        return turned(forward, "s", "d", True).unionByName(turned(backward, "d", "s", False))

    def _hop(self, na: str, a: A.NodePat, rel: A.RelPat, nb: str, b: A.NodePat):
        if rel.var and rel.var in self.new:
            raise BindError(f"relationship {rel.var} used twice in one pattern")
        forward, backward = self._tables(rel, a, b, na, nb)
        tables = tuple(dict.fromkeys([id(t) for t in (*forward, *backward)]))
        by_id = {id(t): t for t in (*forward, *backward)}
        used_tables = [by_id[t] for t in tables]
        known = self.graph.rel_props(used_tables)
        need = self._need(rel)
        props = known if ALL in need else {k: known[k] for k in sorted(need) if k in known}
        if rel.hops is not None:
            return self._var_length(na, a, rel, nb, b)
        prefix = self.k.fresh(rel.var or "r")
        edges = self._oriented(prefix, forward, backward, props)
        binding = Rel(prefix, tuple(used_tables), tuple(props.items()))
        on: list[Column] = []
        near = self._end(na, a, prefix, "n", self._end_labels(forward, backward, True), on)
        far = self._end(nb, b, prefix, "f", self._end_labels(forward, backward, False), on, same_as=na if na == nb else None)
        own = [x for x in self._prop_conditions(binding, rel.props)]
        reads_outer = rel.props is not None and any(isinstance(x, A.Var) and x.name in self.outer for x in A.walk(rel.props))
        if not reads_outer:
            for cond in own:
                edges = edges.filter(cond)
        self._join(edges, on)
        if reads_outer:
            self.extra += own
        self._attach(na, a, near)
        self._attach(nb, b, far)
        self._use(binding, rel)
        if rel.var:
            if rel.var in self.outer:
                if not isinstance(self.outer[rel.var], Rel):
                    raise BindError(f"{rel.var} is no relationship")
                self.holes[rel.var] = binding
            else:
                self.new[rel.var] = binding
        return binding

    def _end_labels(self, forward: list[RelTable], backward: list[RelTable], near: bool) -> tuple[str, ...]:
        fw = {t.src_label if near else t.dst_label for t in forward}
        bw = {t.dst_label if near else t.src_label for t in backward}
        return tuple(sorted(fw | bw))

    def _end(self, name: str, n: A.NodePat, prefix: str, end: str, labels: tuple[str, ...], on: list[Column], same_as: str | None = None) -> Node | None:
        """Tie an end of an edge to a node of the frame, or make it that node.
        Returns the node if it is new."""
        if same_as is not None and same_as not in self.nodes:
            same_as = None
        if name in self.nodes:
            node = self.nodes[name]
            if len(labels) != 1 or node.labels != labels:
                on.append(c(f"{node.prefix}_l") == c(f"{prefix}_{end}_l"))
            on.append(c(f"{node.prefix}_k") == c(f"{prefix}_{end}_k"))
            return None
        node = Node(f"{prefix}_{end}", labels)
        self.nodes[name] = node
        return node

    def _attach(self, name: str, n: A.NodePat, fresh: Node | None) -> None:
        """Join a new node's table, if anything but its identity is needed."""
        if fresh is None:
            self._require(name, n)
            return
        if name in self.outer:
            self.holes[name] = fresh
            self._require(name, n)
            return
        need = self._need(n)
        untested = [x for x in n.labels if fresh.labels != (x,)]
        if not need and not untested and not (self.graph.secondary and n.var and "@labels" in need):
            self._remember(name, n, fresh)
            return
        prefix = self.k.fresh(n.var or "n")
        labels = [x for x in fresh.labels if x in self._candidates(n.labels)]
        node, scan = self.k.scan(prefix, labels, need, tuple(untested))
        on = [c(f"{fresh.prefix}_k") == c(f"{prefix}_k")]
        if len(labels) != 1 or fresh.labels != tuple(labels):
            on.append(c(f"{fresh.prefix}_l") == c(f"{prefix}_l"))
        self.df = self.df.join(scan, _all(on))
        self._remember(name, n, node)
        for cond in self._prop_conditions(node, n.props):
            self._filter_or_defer(cond, n.props)

    def _use(self, binding, rel: A.RelPat) -> None:
        """No relationship twice within a clause; of different types none is."""
        types = set(rel.types) or set(self.graph.types)
        for other, others in self.used:
            if types & others:
                self._distinct_from(binding, other)
        self.used.append((binding, types))

    def _distinct_from(self, mine, other) -> None:
        if isinstance(mine, Rel) and isinstance(other, Rel):
            if {t.type for t in mine.tables} & {t.type for t in other.tables}:
                self.df = self.df.filter(~((c(f"{mine.prefix}_t") == c(f"{other.prefix}_t")) & (c(f"{mine.prefix}_id") == c(f"{other.prefix}_id"))))
            return
        lists = [x for x in (mine, other) if isinstance(x, Value)]
        ident = lambda r: F.struct(r["_l"].alias("t"), r["_k"].alias("id"))
        if len(lists) == 2:
            a, b = (F.transform(c(x.col), ident) for x in lists)
            self.df = self.df.filter(~F.arrays_overlap(a, b))
        else:
            one = mine if isinstance(mine, Rel) else other
            me = F.struct(c(f"{one.prefix}_t").alias("t"), c(f"{one.prefix}_id").alias("id"))
            self.df = self.df.filter(~F.array_contains(F.transform(c(lists[0].col), ident), me))

    # -- variable length

    def _var_length(self, na: str, a: A.NodePat, rel: A.RelPat, nb: str, b: A.NodePat) -> Value:
        if rel.var and rel.var in self.outer:
            return self._pinned(na, a, rel, nb, b)
        lo, hi = rel.hops
        direction = rel.direction
        known_ends = {*self.nodes, *self.outer}
        turned = na not in known_ends and nb in known_ends
        if turned:  # walk from the end that is bound
            na, a, nb, b = nb, b, na, a
            direction = {"in": "out", "out": "in"}.get(direction, direction)
        # inner nodes are free: every table of the type can serve within
        every = [t for t in self.graph.rels if not rel.types or t.type in rel.types]
        fw, bw = (every if direction != "in" else []), (every if direction != "out" else [])
        p = self.k.fresh("step")
        known = self.graph.rel_props(every)
        need = self._need(rel)
        tested = {k for k, _ in rel.props.items} if isinstance(rel.props, A.MapLit) else set(known) if rel.props is not None else set()
        props = known if ALL in need else {k: v for k, v in known.items() if k in need | tested}
        step_binding = Rel(p, tuple(every), tuple(props.items()))
        edges = self._oriented(p, fw, bw, props)
        for cond in self._prop_conditions(step_binding, rel.props):
            if rel.props is not None and any(isinstance(x, A.Var) and x.name in self.outer for x in A.walk(rel.props)):
                raise Unsupported("properties of a variable-length relationship that read variables")
            edges = edges.filter(cond)
        # as a set of pairs, walks of at most hi steps reach what trails do: a shortest walk repeats no relationship
        ends_only = self.k.as_set and not rel.var and not self.named and lo <= 1 and direction != "both" and not self._shared_type(rel)
        if rel.var or self.whole:
            item = self.k.rel_value(step_binding)
        else:
            full = self.k.rel_type(T("map", ())).fields
            item = Typed(F.struct(c(f"{p}_id").alias("_k"), c(f"{p}_t").alias("_l")), T("rel", (("_k", full["_k"]), ("_l", full["_l"]))))
        rel_col = self.k.fresh(rel.var or "rels")
        binding = Value(rel_col, list_of(item.type))
        cols = [c(f"{p}_n_l").alias("e.nl"), c(f"{p}_n_k").alias("e.nk"), c(f"{p}_f_l").alias("e.fl"), c(f"{p}_f_k").alias("e.fk")]
        edges = edges.select(*cols) if ends_only else edges.select(*cols, item.col.alias("e.rel"))
        # the frame to start from
        if na not in self.nodes:
            if na in self.outer:
                keys = self.k.frame().select(*[c(x) for x in _ids(self.outer[na])]).distinct()
                prefix = self.k.fresh("from")
                old = _ids(self.outer[na])
                keys = keys.select(c(old[0]).alias(f"{prefix}_l"), c(old[1]).alias(f"{prefix}_k")).filter(c(f"{prefix}_k").isNotNull())
                self._join(keys, [])
                self.nodes[na] = self.holes[na] = Node(prefix, self.outer[na].labels)
                self._require(na, a)
            else:
                self._alone(na, a)
        else:
            self._require(na, a)
        start = self.nodes[na]
        end = self.k.fresh("to")
        empty = F.array().cast(f"array<{ddl(item.type)}>")
        base = self.df.select("*", c(f"{start.prefix}_l").alias(f"{end}_l"), c(f"{start.prefix}_k").alias(f"{end}_k"), empty.alias(rel_col))
        if hi is not None and hi < lo:
            self.df = base.limit(0)
        elif hi is not None and hi <= UNROLLED:
            self.df = self._unrolled(base, edges, rel_col, end, lo, hi, ends_only)
        else:
            self.df = self._looped(base, edges, rel_col, end, start, lo, hi, ends_only)
        if turned and (rel.var or self.whole):
            self.df = self.df.withColumn(rel_col, F.reverse(c(rel_col)))
        labels = tuple(sorted({x for t in every for x in ((t.dst_label,) if direction == "out" else (t.src_label,) if direction == "in" else (t.src_label, t.dst_label))} | (set(start.labels) if lo == 0 else set())))
        if nb in self.nodes:
            node = self.nodes[nb]
            self.df = self.df.filter((c(f"{end}_l") == c(f"{node.prefix}_l")) & (c(f"{end}_k") == c(f"{node.prefix}_k")))
            self._require(nb, b)
        else:
            fresh = Node(end, labels)
            self.nodes[nb] = fresh
            self._attach(nb, b, fresh)
        self._use(binding, rel)
        if rel.var:
            self.new[rel.var] = binding
        return binding

    def _shared_type(self, rel: A.RelPat) -> bool:
        """Another relationship of the clause could be one of these."""
        others = list(self.rels)
        others.remove(rel)
        return any(not rel.types or not r.types or set(rel.types) & set(r.types) for r in others)

    def _pinned(self, na: str, a: A.NodePat, rel: A.RelPat, nb: str, b: A.NodePat) -> Value:
        """A walk along relationships that are bound before: the list is the walk."""
        bound = self.outer[rel.var]
        if not isinstance(bound, Value) or bound.type.kind != "list" or bound.type.of.kind not in ("rel", "null"):
            raise BindError(f"{rel.var} is no list of relationships")
        lo, hi = rel.hops
        every = [t for t in self.graph.rels if not rel.types or t.type in rel.types]
        if na not in self.outer and na not in self.nodes:
            self._alone(na, a)
        elif na in self.nodes:
            self._require(na, a)
        start = self.nodes.get(na) or self.outer[na]
        if start is self.outer.get(na):
            self.extra += self._label_conditions(start, a.labels) + self._prop_conditions(start, a.props)
        codes = F.array(*[F.lit(self.graph.type_code(x)) for x in sorted({t.type for t in every})]).cast("array<int>")
        walk, n = c(bound.col), F.size(c(bound.col))
        at = F.struct(c(f"{start.prefix}_l").alias("l"), c(f"{start.prefix}_k").alias("k"), F.lit(True).alias("ok"))

        def step(acc: Column, r: Column) -> Column:
            out = (acc["l"] == r["_sl"]) & (acc["k"] == r["_sk"]) & F.lit(rel.direction != "in")
            back = (acc["l"] == r["_dl"]) & (acc["k"] == r["_dk"]) & F.lit(rel.direction != "out")
            far = lambda x, y: F.when(out, r[x]).otherwise(r[y])
            return F.struct(far("_dl", "_sl").alias("l"), far("_dk", "_sk").alias("k"), (acc["ok"] & (out | back) & F.array_contains(codes, r["_l"])).alias("ok"))

        met = F.aggregate(walk, at, step)
        self.extra.append((n >= lo) & (n <= hi if hi is not None else F.lit(True)) & met["ok"])
        end = self.nodes.get(nb) or self.outer.get(nb)
        if end is None:
            self._alone(nb, b)
            end = self.nodes[nb]
        else:
            self.extra += self._label_conditions(end, b.labels) + self._prop_conditions(end, b.props)
        self.extra.append((met["l"] == c(f"{end.prefix}_l")) & (met["k"] == c(f"{end.prefix}_k")))
        self.nodes.setdefault(na, start)
        self.nodes.setdefault(nb, end)
        return bound

    def _unrolled(self, base: DataFrame, edges: DataFrame, rel_col: str, end: str, lo: int, hi: int, ends_only: bool) -> DataFrame:
        """One join per hop, the frames of all allowed lengths together."""
        if ends_only:
            return self._reached(base, edges, end, lo, hi)
        out, now = [], base
        if lo == 0:
            out.append(now)
        for hop in range(1, hi + 1):
            on = (c(f"{end}_l") == c("e.nl")) & (c(f"{end}_k") == c("e.nk"))
            now = now.join(edges, on)
            if hop > 1:
                now = now.filter(~F.exists(c(rel_col), lambda r: (r["_l"] == c("e.rel")["_l"]) & (r["_k"] == c("e.rel")["_k"])))
            now = now.withColumns({rel_col: F.concat(c(rel_col), F.array(c("e.rel"))), f"{end}_l": c("e.fl"), f"{end}_k": c("e.fk")}).drop("e.nl", "e.nk", "e.fl", "e.fk", "e.rel")
            if hop >= lo:
                out.append(now)
        result = out[0]
        for f in out[1:]:
            result = result.unionByName(f)
        return result

    @staticmethod
    def _reached(base: DataFrame, edges: DataFrame, end: str, lo: int, hi: int) -> DataFrame:
        """The ends within *hi* hops as one chain of joins: each hop keeps the
        end it starts from beside those it leads to, and doubles go at once."""
        on = (c(f"{end}_l") == c("e.nl")) & (c(f"{end}_k") == c("e.nk"))
        spent = ("e.nl", "e.nk", "e.fl", "e.fk")
        now = base
        for hop in range(1, hi + 1):
            if hop == 1 and lo == 1:
                now = now.join(edges, on).withColumns({f"{end}_l": c("e.fl"), f"{end}_k": c("e.fk")}).drop(*spent)
            else:
                own, far = (F.struct(c(x).alias("l"), c(y).alias("k")) for x, y in ((f"{end}_l", f"{end}_k"), ("e.fl", "e.fk")))
                both = F.when(c("e.fk").isNull(), F.array(own)).otherwise(F.array(own, far))
                now = now.join(edges, on, "left").withColumn("e.at", F.explode(both))
                now = now.withColumns({f"{end}_l": c("e.at")["l"], f"{end}_k": c("e.at")["k"]}).drop(*spent, "e.at")
            now = now.distinct()
        return now

    def _looped(self, base: DataFrame, edges: DataFrame, rel_col: str, end: str, start: Node, lo: int, hi: int | None, ends_only: bool) -> DataFrame:
        """Walks of any length: the newest ones, as a written table, grow by one
        hop a round until none grows or *hi* is reached.  No limit on rounds or
        rows is set; trails end because no relationship comes twice, sets of
        ends because a pair once reached is not followed again."""
        edges = materialize(edges, "walk-edges")
        seeds = self.df.select(c(f"{start.prefix}_l").alias("w.sl"), c(f"{start.prefix}_k").alias("w.sk")).distinct()
        now = materialize(seeds.select("*", c("w.sl").alias("w.fl"), c("w.sk").alias("w.fk"), F.array().cast(base.schema[rel_col].dataType).alias("w.rels")), "walk")
        pair = ["w.sl", "w.sk", "w.fl", "w.fk"]
        out, hop = ([now] if lo == 0 else []), 0
        seen = now if lo == 0 else now.limit(0)
        while hi is None or hop < hi:
            hop += 1
            grown = now.join(edges, (c("w.fl") == c("e.nl")) & (c("w.fk") == c("e.nk")))
            if ends_only:
                grown = grown.select(c("w.sl"), c("w.sk"), c("e.fl").alias("w.fl"), c("e.fk").alias("w.fk"), c("w.rels")).dropDuplicates(pair)
                old = seen.select(*[c(x).alias(x.replace("w.", "o.")) for x in pair])
                grown = grown.join(old, _all([c(x) == c(x.replace("w.", "o.")) for x in pair]), "left_anti")
            else:
                grown = grown.filter(~F.exists(c("w.rels"), lambda r: (r["_l"] == c("e.rel")["_l"]) & (r["_k"] == c("e.rel")["_k"])))
                grown = grown.select(c("w.sl"), c("w.sk"), c("e.fl").alias("w.fl"), c("e.fk").alias("w.fk"), F.concat(c("w.rels"), F.array(c("e.rel"))).alias("w.rels"))
            now = materialize(grown, "walk")
            if now.isEmpty():
                break
            if ends_only:
                seen = seen.unionByName(now)
            if hop >= lo:
                out.append(now)
        walked = out[0] if out else now.limit(0)
        for f in out[1:]:
            walked = walked.unionByName(f)
        on = (c(f"{start.prefix}_l") == c("w.sl")) & (c(f"{start.prefix}_k") == c("w.sk"))
        joined = base.join(walked, on)
        return joined.withColumns({rel_col: c("w.rels"), f"{end}_l": c("w.fl"), f"{end}_k": c("w.fk")}).drop("w.sl", "w.sk", "w.fl", "w.fk", "w.rels")


# -- small helpers -----------------------------------------------------------


def _all(on: list[Column]) -> Column:
    out = None
    for x in on:
        out = x if out is None else out & x
    return F.lit(True) if out is None else out


def _ids(b) -> list[str]:
    if isinstance(b, Node):
        return [f"{b.prefix}_l", f"{b.prefix}_k"]
    if isinstance(b, Rel):
        return [f"{b.prefix}_t", f"{b.prefix}_id"]
    return b.columns()


def _identity(b) -> list[str]:
    """Columns that decide equality of rows."""
    if isinstance(b, Path):
        return [x for part in (*b.nodes, *b.rels) for x in _ids(part)]
    return _ids(b)


def _same(x, y) -> Column:
    out = None
    for a, b in zip(_ids(x), _ids(y)):
        one = c(a) == c(b)
        out = one if out is None else out & one
    return out


def _names(tree) -> set[str]:
    """Variables that a clause reads or binds."""
    out = set()
    for x in A.walk(tree):
        if isinstance(x, A.Var):
            out.add(x.name)
        elif isinstance(x, A.Path):
            out |= {part.var for part in (*x.nodes, *x.rels) if part.var}
    return out


def _as_sets(clauses) -> list[bool]:
    """For each clause whether repetitions among the rows it makes can be told
    by the result: not if a DISTINCT or aggregates blind to them come first."""
    out, blind = [False] * len(clauses), False
    for i in range(len(clauses) - 1, -1, -1):
        out[i] = blind
        x = clauses[i]
        if isinstance(x, A.Project):
            calls = [e for item in (*x.items, *x.order) for e in A.walk(item.expr) if isinstance(e, A.Call) and e.name.lower() in AGGREGATES]
            if calls:
                blind = all(e.distinct or e.name.lower() in ("min", "max") for e in calls)
            else:
                blind = x.distinct or blind and x.skip is None and x.limit is None
        elif not isinstance(x, (A.Match, A.Unwind, A.CallProc)):
            blind = False
    return out


def _aggregates(e: A.Expr) -> bool:
    return any(isinstance(x, A.Call) and x.name.lower() in AGGREGATES for x in A.walk(e))


def _rebuilt(e, f: Callable):
    """A copy of a tree with *f* applied to its direct expressions."""

    def each(v):
        if isinstance(v, tuple):
            return tuple(each(x) for x in v)
        return f(v) if isinstance(v, A.Expr) else v

    return replace(e, **{name: each(getattr(e, name)) for name in e.__dataclass_fields__})


def _replaced(e: A.Expr, by: dict[A.Expr, str]) -> A.Expr:
    if e in by:
        return A.Var(by[e])
    return _rebuilt(e, lambda x: _replaced(x, by))


def _sort_key(v: Typed, descending: bool) -> Column:
    """Ascending puts null last, descending is the exact reverse."""
    col = v.col
    if v.kind in ("node", "rel"):
        col = F.struct(v.col["_l"], v.col["_k"])
        col = F.when(v.col.isNotNull(), col)
    return col.desc_nulls_first() if descending else col.asc_nulls_last()


