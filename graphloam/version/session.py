"""Queries that read and write a repository.

A clause that writes cuts the frame of bound rows into a written table, applies
its changes to the tables of the workspace as sets of rows, and refreshes the
bound entities, so later clauses see them.  Where the language goes row by row
(a later row of MERGE meets what an earlier one made, the last of several SETs
on one entity holds) the frame's row numbers decide.  The workspace changes only
when the whole query went through.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloam.cypher import ast as A
from graphloam.cypher.compiler import Compiler, Node, Path, Rel, Value, c
from graphloam.cypher.errors import BindError, CypherTypeError, Unsupported, WriteError
from graphloam.cypher.graph import DST, KEY, LABELS, SRC, did_you_mean
from graphloam.cypher.parser import parse
from graphloam.cypher.types import NULL, STR, Typed
from graphloam.session import materialize
from graphloam.version.procedures import procedures
from graphloam.version.repo import DISC, EDGE_KEY, GraphRepo, edge_name, key_text

ROW = "__row"


@dataclass
class Summary:
    nodes_created: int = 0
    nodes_deleted: int = 0
    relationships_created: int = 0
    relationships_deleted: int = 0
    properties_set: int = 0
    labels_added: int = 0
    labels_removed: int = 0

    def __bool__(self) -> bool:
        return any(getattr(self, f.name) for f in fields(self))


class RepoSession:
    """Cypher over the workspace of a repository, or over one version of it
    (*at*), which can't be written.  *autodeclare* lets a query coin
    relationship types."""

    def __init__(self, repo: GraphRepo, *, at: str | None = None, autodeclare: bool = False) -> None:
        self.repo, self.at, self.autodeclare = repo, at, autodeclare
        self.summary = Summary()

    def run(self, text: str, params: dict | None = None) -> DataFrame:
        query = parse(text)
        self.summary = Summary()
        how = {"at": self.repo.graph, "procedures": procedures(self.repo)}
        if not query.writes:
            return Compiler(self.repo.graph(self.at), params, **how).run(query)
        if self.at is not None:
            raise WriteError("a past version can't be written")
        k = Writer(self, params, **how)
        out = k.run(query)
        if any(isinstance(x, A.Project) and x.final for x in query.clauses):
            out = materialize(out, "result")
        k.close()
        self.repo.save(k.m)
        return out


class Writer(Compiler):
    def __init__(self, session: RepoSession, params, **how) -> None:
        self.repo, self.session, self.m = session.repo, session, session.repo.workspace
        super().__init__(self.repo.graph(manifest=self.m), params, **how)
        self.summary = session.summary
        self.touched: set[str] = set()
        self.removing = False  # REMOVE, not SET

    def clause(self, clause: A.Clause) -> None:
        self.as_set = False
        run = {A.Create: self.create, A.Merge: self.merge, A.Set: self.set, A.Remove: self.set, A.Delete: self.delete}.get(type(clause))
        if run is None:
            return super().clause(clause)
        # nothing may be pruned from entities that a later clause reads after the change
        self.cut()
        run(clause)

    def cut(self) -> None:
        """The frame as a written table with row numbers."""
        df = self.frame()
        df = df.drop(ROW) if ROW in df.columns else df
        self.df = materialize(df.withColumn(ROW, F.monotonically_increasing_id()), "frame")

    def close(self) -> None:
        """Constraints that hold at the end of a query."""
        found = self.repo.violations(self.m, self.repo.workspace)
        if found:
            raise WriteError("; ".join(found))

    def renew(self, keep: bool = True) -> None:
        """The graph after a change, and the frame's entities as they are there."""
        self.graph = self.repo.graph(manifest=self.m)
        if not keep:
            return
        for name, b in list(self.scope.items()):
            if isinstance(b, Node):
                self.scope[name] = self._renewed_node(name, b)
            elif isinstance(b, Rel):
                self.scope[name] = self._renewed_rel(name, b)

    def _need_of(self, name: str) -> set[str]:
        return set(self.needs.get(name)) | self.needs.get("*")

    def _renewed_node(self, name: str, b: Node) -> Node:
        prefix = self.fresh(name)
        labels = [x for x in b.labels if x in self.graph.nodes]
        node, scan = self.scan(prefix, labels or list(self.graph.nodes), self._need_of(name) | {k for k, _ in b.props}, ())
        on = (c(f"{b.prefix}_l") == c(f"{prefix}_l")) & (c(f"{b.prefix}_k") == c(f"{prefix}_k"))
        self.df = self.df.join(scan, on, "left").drop(*b.columns())
        return node

    def _renewed_rel(self, name: str, b: Rel) -> Rel:
        prefix = self.fresh(name)
        kinds = {(t.type, t.src_label, t.dst_label) for t in b.tables}
        tables = [t for t in self.graph.rels if (t.type, t.src_label, t.dst_label) in kinds]
        known, need = self.graph.rel_props(tables), self._need_of(name) | {k for k, _ in b.props}
        props = known if "*" in need else {k: v for k, v in known.items() if k in need}
        scan = self.graph.scan_rels(tables, prefix, props)
        same = [c(f"{b.prefix}_{x}") == c(f"{prefix}_{x}") for x in ("t", "id", "sl", "dl")]
        self.df = self.df.join(scan, same[0] & same[1] & same[2] & same[3], "left").drop(*b.columns())
        return Rel(prefix, tuple(tables), tuple(props.items()))

    # -- CREATE

    def create(self, clause: A.Create) -> None:
        for path in clause.paths:
            if path.var:
                raise Unsupported("a name for a path that is created")
            for n in path.nodes:
                if n.var in self.scope and (n.labels or n.props is not None):
                    raise BindError(f"{n.var} is bound and can't get labels or properties in CREATE")
            self._check_rels(path)
        for path in clause.paths:
            self._create(path)

    def _check_rels(self, path: A.Path) -> None:
        for r in path.rels:
            if r.hops is not None or len(r.types) != 1 or r.direction == "both":
                raise BindError("a relationship is created with one type and a direction")
            if r.var and r.var in self.scope:
                raise BindError(f"variable {r.var} is already bound")

    def _create(self, path: A.Path, only: Column | None = None) -> None:
        names = []
        for n in path.nodes:
            name = n.var or self.fresh("new")
            if name not in self.scope:
                self._create_node(name, n, only)
            elif not isinstance(self.scope[name], Node):
                raise BindError(f"{name} is no node")
            names.append(name)
        for i, r in enumerate(path.rels):
            a, b = (names[i], names[i + 1]) if r.direction == "out" else (names[i + 1], names[i])
            self._create_rel(r, a, b, only)

    def identity(self, labels: tuple[str, ...]) -> str:
        """The one label among *labels* that has a key."""
        keyed = [x for x in labels if x in self.m.schema["labels"]]
        if not keyed:
            raise WriteError(f"a node needs a label with a key; {', '.join(labels) or 'none'}" + (did_you_mean(labels[0], self.m.schema["labels"]) if labels else ""))
        if len(keyed) > 1:
            raise WriteError(f"a node can't have its identity from several labels: {', '.join(keyed)}")
        return keyed[0]

    def _given(self, props: A.Expr | None) -> dict[str, Typed]:
        if props is None:
            return {}
        v = self.expr(props, self.scope)
        if v.kind != "map":
            raise CypherTypeError(f"properties are a map, not {v.kind}")
        return {k: Typed(v.col.getField(k), t) for k, t in v.type.args}

    def _create_node(self, name: str, n: A.NodePat, only: Column | None = None) -> None:
        label = self.identity(n.labels)
        d = self.m.schema["labels"][label]
        given = self._given(n.props)
        if d["surrogate"]:
            given["_id"] = Typed(F.expr("uuid()"), STR)
        missing = [k for k in d["key"] if k not in given or given[k].kind == "null"]
        if missing:
            raise WriteError(f"{label} needs its key {', '.join(missing)}")
        prefix = self.fresh(name)
        cols = {f"{prefix}.{k}": v.col if v.kind != "null" else v.col.cast("string") for k, v in given.items()}
        self.df = self.df.withColumns(cols)
        if d["surrogate"]:
            self.df = materialize(self.df, "frame")
        key = key_text([c(f"{prefix}.{k}") for k in d["key"]])
        self.df = self.df.withColumns({f"{prefix}_l": F.lit(self.graph.label_code(label)), f"{prefix}_k": key})
        second = [x for x in n.labels if x != label]
        rows = self.df if only is None else self.df.filter(only)
        rows = rows.select(*[c(f"{prefix}.{k}").alias(k) for k in given], F.array(*[F.lit(x) for x in second]).cast("array<string>").alias(LABELS))
        rows = materialize(rows, "created")
        self.repo.put_nodes(self.m, label, rows, new_only=True)
        self.touched.add(label)
        self.summary.nodes_created += rows.count()
        self.summary.labels_added += rows.count() * len(set(n.labels))
        self.summary.properties_set += self._present(rows, list(given))
        self.scope[name] = Node(prefix, (label,), tuple((k, v.type) for k, v in given.items()))
        self.renew()

    @staticmethod
    def _present(rows: DataFrame, cols: list[str]) -> int:
        return sum(rows.agg(*[F.count(f"`{x}`") for x in cols]).head()) if cols else 0

    def _create_rel(self, r: A.RelPat, a: str, b: str, only: Column | None = None) -> None:
        rtype = r.types[0]
        d = self.m.schema["relationship_types"].get(rtype)
        if d is None and not self.session.autodeclare:
            raise BindError(f"unknown relationship type {rtype}" + did_you_mean(rtype, self.m.schema["relationship_types"]))
        disc = d["discriminator"] if d else None
        given = self._given(r.props)
        prefix = self.fresh(r.var or "rel")
        src, dst = self.scope[a], self.scope[b]
        self.df = self.df.withColumns({f"{prefix}.{k}": v.col if v.kind != "null" else v.col.cast("string") for k, v in given.items()})
        text = F.coalesce(c(f"{prefix}.{disc}").cast("string"), F.lit("")) if disc in given else F.lit("")
        ends = {"sl": c(f"{src.prefix}_l"), "sk": c(f"{src.prefix}_k").cast("string"), "dl": c(f"{dst.prefix}_l"), "dk": c(f"{dst.prefix}_k").cast("string")}
        self.df = self.df.withColumns({f"{prefix}_{x}": v for x, v in ends.items()})
        self.df = self.df.withColumn(f"{prefix}_id", F.to_json(F.array(f"{prefix}_sk", f"{prefix}_dk", text)))
        rows = self.df if only is None else self.df.filter(only)
        if not rows.filter(c(f"{prefix}_sk").isNull() | c(f"{prefix}_dk").isNull()).isEmpty():
            raise WriteError(f"an end of {rtype} is null")
        for x in src.labels:
            for y in dst.labels:
                part = rows.filter((c(f"{prefix}_sl") == self.graph.label_code(x)) & (c(f"{prefix}_dl") == self.graph.label_code(y)))
                part = materialize(part.select(c(f"{prefix}_sk").alias(SRC), c(f"{prefix}_dk").alias(DST), text.alias(DISC), *[c(f"{prefix}.{k}").alias(k) for k in given]), "created")
                n = part.count()
                if n or (len(src.labels) == len(dst.labels) == 1):
                    self.repo.put_edges(self.m, rtype, x, y, part, new_only=True, declare=self.session.autodeclare)
                    self.touched.add(edge_name(rtype, x, y))
                    self.summary.relationships_created += n
                    self.summary.properties_set += self._present(part, list(given))
        self.graph = self.repo.graph(manifest=self.m)
        self.df = self.df.withColumn(f"{prefix}_t", F.lit(self.graph.type_code(rtype)))
        if r.var:
            tables = tuple(t for t in self.graph.rels if t.type == rtype and t.src_label in src.labels and t.dst_label in dst.labels)
            self.scope[r.var] = Rel(prefix, tables, tuple((k, v.type) for k, v in given.items()))
        self.renew()

    # -- MERGE

    def merge(self, m: A.Merge) -> None:
        path = m.path
        if path.var:
            raise Unsupported("a name for a path that is merged")
        for r in path.rels:
            if r.hops is not None or len(r.types) != 1:
                raise BindError("a relationship is merged with one type")
        outer = dict(self.scope)
        asked = self._merge_values(path, outer)
        if asked:
            null = self.df.filter(_any([v.isNull() for v in asked]))
            if not null.isEmpty():
                raise WriteError("MERGE with a null property")
        frame = self.df
        for r in path.rels:
            if r.types[0] not in self.graph.types and self.session.autodeclare:
                from graphloam.version import schema as S

                self.m.schema["relationship_types"][r.types[0]] = S.relationship()
                self.graph = self.repo.graph(manifest=self.m)
        self.match(A.Match(False, (path,), None, None))
        met = materialize(self.df.select(ROW).distinct(), "met")
        rest = frame.join(met, ROW, "left_anti")
        first = F.lit("met")
        self.df, self.scope = frame, dict(outer)
        if not rest.isEmpty():
            # what several rows ask for alike is made by the first of them
            ids = [c(f"{outer[n.var].prefix}_{x}") for n in path.nodes if n.var in outer for x in "lk"]
            same = W.partitionBy(*(ids + asked or [F.lit(1)])).orderBy(ROW)
            ranked = materialize(rest.withColumn("__n", F.row_number().over(same)).select(ROW, "__n"), "ranked")
            first = F.when(F.col("__n") == 1, "made").otherwise("met")
            self.df = rest.join(ranked.filter("__n = 1").select(ROW), ROW, "left_semi")
            self.cut()
            as_created = A.Path(None, path.nodes, tuple(A.RelPat(r.var, r.types, "out" if r.direction == "both" else r.direction, None, r.props) for r in path.rels))
            self._create(as_created)
            self.scope = dict(outer)
            self.df = frame.join(ranked, ROW, "left")
        else:
            self.df = frame.withColumn("__n", F.lit(None).cast("int"))
        how = self.fresh("how")
        self.df = materialize(self.df.withColumn(how, first).drop("__n"), "frame")
        self.match(A.Match(False, (path,), None, None))
        for which, items in (("made", m.on_create), ("met", m.on_match)):
            if items:
                self.cut()
                self.items(items, c(how) == which)

    def _merge_values(self, path: A.Path, scope) -> list[Column]:
        out = []
        for part in (*path.nodes, *path.rels):
            if part.props is not None:
                v = self.expr(part.props, scope)
                if v.kind != "map":
                    raise CypherTypeError(f"properties are a map, not {v.kind}")
                out += [v.col.getField(k) for k, _ in v.type.args]
        return out

    # -- SET, REMOVE

    def set(self, clause: A.Set | A.Remove) -> None:
        self.removing = isinstance(clause, A.Remove)
        self.items(clause.items, None)
        self.removing = False

    def items(self, items, only: Column | None) -> None:
        for item in items:
            b = self.lookup(item.target.name, self.scope) if isinstance(item.target, A.Var) else None
            if isinstance(b, Value) and b.type.kind == "null":
                continue
            if not isinstance(b, (Node, Rel)):
                raise BindError("only properties of bound nodes and relationships can be set")
            if item.kind == "labels" and isinstance(b, Rel):
                raise BindError("labels belong to nodes")
            self._set(item, b, only)

    def _set(self, item: A.SetItem, b, only: Column | None) -> None:
        removing = item.value is None
        entries: dict[str, Typed] = {}
        if item.kind == "prop":
            entries = {item.key: self.expr(item.value, self.scope) if not removing else Typed(F.lit(None).cast("string"), NULL)}
        elif item.kind in ("replace", "merge"):
            v = self.expr(item.value, self.scope)
            if v.kind in ("node", "rel"):
                v = Typed(v.col["properties"], v.type.fields["properties"])
            if v.kind == "null":
                if item.kind == "merge":
                    return
            elif v.kind != "map":
                raise CypherTypeError(f"properties are a map, not {v.kind}")
            else:
                entries = {k: Typed(v.col.getField(k), t) for k, t in v.type.args}
        names = {k: f"__v{i}" for i, k in enumerate(entries)}
        cols = [(e.col if e.kind != "null" else e.col.cast("string")).alias(names[k]) for k, e in entries.items()]
        idc = f"{b.prefix}_k" if isinstance(b, Node) else f"{b.prefix}_id"
        frame = self.df.filter(c(idc).isNotNull())
        frame = frame if only is None else frame.filter(only)
        for table, keys, where, key_cols in self._tables_of(b):
            chosen = frame.filter(where).select(*key_cols, ROW, *cols)
            packed = F.struct(*[F.col(names[k]).alias(names[k]) for k in entries]) if entries else F.struct(F.lit(1).alias("x"))
            last = chosen.groupBy(*keys).agg(F.max_by(packed, ROW).alias("__new"))
            self._change(item, b, table, keys, last, entries, names)
        self.renew()

    def _tables_of(self, b):
        """Tables that rows of an entity variable can be in, with their keys."""
        if isinstance(b, Node):
            for label in b.labels:
                if label in self.m.nodes:
                    yield label, [KEY], c(f"{b.prefix}_l") == self.graph.label_code(label), [c(f"{b.prefix}_k").cast("string").alias(KEY)]
        else:
            for t in b.tables:
                name = edge_name(t.type, t.src_label, t.dst_label)
                if name in self.m.edges:
                    p = b.prefix
                    where = (c(f"{p}_t") == self.graph.type_code(t.type)) & (c(f"{p}_sl") == self.graph.label_code(t.src_label)) & (c(f"{p}_dl") == self.graph.label_code(t.dst_label))
                    disc = F.from_json(c(f"{p}_id"), "array<string>")[2]
                    yield name, list(EDGE_KEY), where, [c(f"{p}_sk").cast("string").alias(SRC), c(f"{p}_dk").cast("string").alias(DST), disc.alias(DISC)]

    def _change(self, item, b, table: str, keys: list[str], last: DataFrame, entries: dict, names: dict) -> None:
        node = isinstance(b, Node)
        old = (self.m.nodes if node else self.m.edges)[table]
        if node:
            fixed = self.m.schema["labels"][table]["key"]
        else:
            disc = self.m.schema["relationship_types"].get(json.loads(table)[0], {}).get("discriminator")
            fixed = [disc] if disc else []
        touched = [k for k in entries if k in fixed]
        if item.kind == "prop" and touched:
            raise WriteError(f"{', '.join(touched)} is part of a key and can't be set")
        rows = self.repo.table(old).join(last, keys)
        have = {f.name: f.dataType.simpleString() for f in old.type.fields}
        special = {*keys, LABELS}
        if touched:
            moved = rows.filter(_any([~F.col(f"`{k}`").cast("string").eqNullSafe(F.col(f"__new.{names[k]}").cast("string")) for k in touched]))
            if not moved.isEmpty():
                raise WriteError(f"{', '.join(touched)} is part of a key and can't be set")
        new = {}
        if item.kind == "labels":
            given = F.array(*[F.lit(x) for x in item.labels if x != table])
            has = F.coalesce(F.col(LABELS), F.array().cast("array<string>"))
            other = [x for x in item.labels if x in self.m.schema["labels"] and x != table]
            if other and not self.removing:
                raise WriteError(f"a node can't have its identity from several labels: {table}, {', '.join(other)}")
            if self.removing and table in item.labels:
                raise WriteError(f"{table} gives the node its identity and can't be removed")
            new[LABELS] = F.array_except(has, given) if self.removing else F.array_union(has, given)
        else:
            if item.kind == "replace":
                new = {x: F.lit(None).cast(t) for x, t in have.items() if x not in special and x not in fixed and x not in entries}
            for k, e in entries.items():
                if k in fixed:
                    continue
                value = F.col(f"__new.{names[k]}")
                if e.kind == "null" and k in have:
                    value = value.cast(have[k])
                new[k] = value
        out = materialize(rows.withColumns(new).drop("__new"), "set")
        if item.kind == "labels":
            change = F.size(LABELS) - F.coalesce(F.size("__old"), F.lit(0))
            both = out.join(self.repo.table(old).select(*keys, F.coalesce(LABELS, F.array().cast("array<string>")).alias("__old")), keys)
            n = both.agg(F.coalesce(F.sum(F.abs(change)), F.lit(0))).head()[0]
            self.summary.labels_removed += n if self.removing else 0
            self.summary.labels_added += 0 if self.removing else n
        else:
            self.summary.properties_set += out.count() * max(1, len(entries))
        self.touched.add(table)
        if node:
            self.repo.put_nodes(self.m, table, out.drop(KEY))
        else:
            rtype, src, dst = json.loads(table)
            self.repo.put_edges(self.m, rtype, src, dst, out)

    # -- DELETE

    def delete(self, d: A.Delete) -> None:
        nodes: dict[str, list[DataFrame]] = {}
        edges: dict[str, list[DataFrame]] = {}

        def add(b) -> None:
            if isinstance(b, Path):
                for part in (*b.nodes, *b.rels):
                    add(part)
            elif isinstance(b, (Node, Rel)):
                into = nodes if isinstance(b, Node) else edges
                for table, keys, where, cols in self._tables_of(b):
                    into.setdefault(table, []).append(self.df.filter(where & _present(cols)).select(*cols))
            elif isinstance(b, Value) and b.type.kind == "list" and b.type.of.kind == "rel":
                each = self.df.select(F.explode(c(b.col)).alias("r"))
                for name in self.m.edges:
                    rtype, src, dst = json.loads(name)
                    own = each.filter((F.col("r._l") == self.graph.type_code(rtype)))
                    cols = [F.from_json("r._k", "array<string>")[i].alias(x) for i, x in enumerate(EDGE_KEY)]
                    edges.setdefault(name, []).append(own.select(*cols))
            elif not (isinstance(b, Value) and b.type.kind == "null"):
                raise CypherTypeError("only nodes, relationships and paths can be deleted")

        for target in d.targets:
            if not isinstance(target, A.Var):
                raise Unsupported("DELETE of anything but a variable")
            add(self.lookup(target.name, self.scope))
        for name, frames in edges.items():
            self.summary.relationships_deleted += self._drop_edges(name, _union(frames))
        for label, frames in nodes.items():
            before = {n: t.rows for n, t in self.m.edges.items()}
            keys = materialize(_union(frames).distinct(), "deleted")
            had = self.m.nodes[label].rows
            self.repo.delete_nodes(self.m, label, keys, detach=d.detach)
            self.touched |= {label, *before}
            self.summary.nodes_deleted += had - self.m.nodes[label].rows
            self.summary.relationships_deleted += sum(before.values()) - sum(self.m.edges[n].rows for n in before)
        self.renew(keep=False)

    def _drop_edges(self, name: str, keys: DataFrame) -> int:
        had = self.m.edges[name].rows
        self.repo.delete_edges(self.m, name, materialize(keys.distinct(), "deleted"))
        self.touched.add(name)
        return had - self.m.edges[name].rows


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for x in conditions:
        out = out | x
    return out


def _present(cols: list[Column]) -> Column:
    out = F.lit(True)
    for x in cols:
        out = out & x.isNotNull()
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out
