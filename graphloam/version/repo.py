"""A graph with its history, in one directory.

``data/`` holds immutable table buckets, ``manifests/`` the tables and schema of
a version under the hash of its contents, ``commits/`` the history, ``refs.json``
branches and tags, ``workspace.json`` the state that is not committed yet.
Metadata are small and handled by the driver; rows never are.  One writer at a
time; readers pin a manifest, which nothing changes.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloam.cypher.errors import BindError, CypherError
from graphloam.cypher.graph import DST, EID, KEY, LABELS, SRC, Graph, NodeTable, RelTable, did_you_mean
from graphloam.version import schema as S
from graphloam.version.compare import Merged, diff as diff_tables, merge as merge_tables
from graphloam.version.files import Files
from graphloam.version.tables import Table, TableStore

DISC = "_disc"
EDGE_KEY = (SRC, DST, DISC)
NODE_DDL = f"{KEY} string, {LABELS} array<string>"
EDGE_DDL = f"{SRC} string, {DST} string, {DISC} string"


def key_text(columns: list[Column]) -> Column:
    """A key as one text: its only part, or the parts as a JSON list."""
    parts = [x.cast("string") for x in columns]
    if len(parts) == 1:
        return parts[0]
    present = parts[0].isNotNull()
    for p in parts[1:]:
        present = present & p.isNotNull()
    return F.when(present, F.to_json(F.array(*parts)))


def edge_name(rtype: str, src: str, dst: str) -> str:
    return json.dumps([rtype, src, dst])


@dataclass
class Manifest:
    """The schema and tables of one version."""

    schema: dict = field(default_factory=lambda: json.loads(json.dumps(S.EMPTY)))
    nodes: dict[str, Table] = field(default_factory=dict)
    edges: dict[str, Table] = field(default_factory=dict)  # by edge_name

    def to_json(self) -> dict:
        return {"schema": self.schema, "nodes": {k: t.to_json() for k, t in self.nodes.items()}, "edges": {k: t.to_json() for k, t in self.edges.items()}}

    @staticmethod
    def from_json(d: dict) -> Manifest:
        return Manifest(d["schema"], {k: Table.from_json(t) for k, t in d["nodes"].items()}, {k: Table.from_json(t) for k, t in d["edges"].items()})

    def copy(self) -> Manifest:
        return Manifest(json.loads(json.dumps(self.schema)), dict(self.nodes), dict(self.edges))

    @property
    def hash(self) -> str:
        """The same for the same contents, however they came about."""
        own = {"schema": self.schema, "nodes": {k: t.hash for k, t in self.nodes.items() if t.rows}, "edges": {k: t.hash for k, t in self.edges.items() if t.rows}}
        return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()


class GraphRepo:
    def __init__(self, spark: SparkSession, root: str, rows_per_bucket: int | None = None) -> None:
        self.spark, self.files = spark, Files(spark, root)
        self.store = TableStore(spark, self.files, **({"rows_per_bucket": rows_per_bucket} if rows_per_bucket else {}))
        if not self.files.exists("refs.json"):
            self.files.write_json("refs.json", {"heads": {}, "tags": {}, "head": "main", "detached": False})
            self._save(Manifest())

    # -- metadata

    @property
    def refs(self) -> dict:
        return self.files.json("refs.json")

    @property
    def workspace(self) -> Manifest:
        return Manifest.from_json(self.files.json("workspace.json")["manifest"])

    @property
    def merging(self) -> dict | None:
        return self.files.json("workspace.json")["merging"]

    def _save(self, m: Manifest, merging: dict | None = None) -> None:
        self.files.write_json("workspace.json", {"manifest": m.to_json(), "merging": merging})

    def save(self, m: Manifest) -> None:
        """Make *m* the workspace, in one step."""
        self._save(m, self.merging)

    def read_commit(self, cid: str) -> dict:
        return self.files.json(f"commits/{cid}.json")

    def manifest(self, ref: str | None = None) -> Manifest:
        if ref is None:
            return self.workspace
        return Manifest.from_json(self.files.json(f"manifests/{self.read_commit(self.resolve(ref))['manifest']}.json"))

    # -- refs and history

    @property
    def head(self) -> str | None:
        r = self.refs
        return r["head"] if r["detached"] else r["heads"].get(r["head"])

    def resolve(self, spec: str) -> str:
        """``refs/heads/x``, ``refs/tags/x``, a tag, a branch, ``HEAD`` or hex
        digits that begin one commit, followed by ``~n`` (n first parents back)
        and ``^n`` (the n-th parent)."""
        cut = min([i for i in (spec.find("~"), spec.find("^")) if i >= 0], default=len(spec))
        name, steps, r = spec[:cut], spec[cut:], self.refs
        if name == "HEAD":
            found = self.head
        elif name.startswith("refs/heads/"):
            found = r["heads"].get(name.removeprefix("refs/heads/"))
        elif name.startswith("refs/tags/"):
            found = r["tags"].get(name.removeprefix("refs/tags/"))
        else:
            found = r["tags"].get(name) or r["heads"].get(name)
            if found is None and len(name) >= 4 and set(name) <= set("0123456789abcdef"):
                near = [f.removesuffix(".json") for f in self.files.list("commits") if f.startswith(name)]
                if len(near) > 1:
                    raise CypherError(f"{name} begins {len(near)} commits")
                found = near[0] if near else None
        if found is None:
            raise BindError(f"no version {spec}" + did_you_mean(name, [*r["heads"], *r["tags"]]))
        while steps:
            op, digits = steps[0], ""
            steps = steps[1:]
            while steps and steps[0].isdigit():
                digits, steps = digits + steps[0], steps[1:]
            if op not in "~^" or steps and steps[0] not in "~^":
                raise BindError(f"no version {spec}")
            n = int(digits or 1)
            for _ in range(n if op == "~" else 1 if n else 0):
                parents = self.read_commit(found)["parents"]
                at = 0 if op == "~" else n - 1
                if at >= len(parents):
                    raise BindError(f"{spec} goes beyond the first commit")
                found = parents[at]
        return found

    def commit(self, message: str, *, author: str = "", trailers: dict | None = None, allow_empty: bool = False, at: float | None = None) -> str:
        m, merging, head, r = self.workspace, self.merging, self.head, self.refs
        if merging and merging.get("conflicts"):
            raise CypherError("the merge has conflicts that are not resolved")
        if merging:
            self.validate(m)
        if head is not None and not merging and not allow_empty and self.manifest(head).hash == m.hash:
            raise CypherError("nothing to commit")
        mid = m.hash
        if not self.files.exists(f"manifests/{mid}.json"):
            self.files.write_json(f"manifests/{mid}.json", m.to_json())
        parents = ([head] if head else []) + ([merging["theirs"]] if merging else [])
        body = {"manifest": mid, "parents": parents, "message": message, "author": author, "time": time.time() if at is None else at, "trailers": trailers or {}}
        cid = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
        self.files.write_json(f"commits/{cid}.json", body)
        self._advance(r, cid)
        self.files.write_json("refs.json", r)
        self._save(m)
        return cid

    @staticmethod
    def _advance(refs: dict, cid: str) -> None:
        """Move the branch that is checked out, or the detached head."""
        if refs["detached"]:
            refs["head"] = cid
        else:
            refs["heads"][refs["head"]] = cid

    def log(self, ref: str = "HEAD", *, every: bool = False) -> list[dict]:
        """Commits along first parents, newest first; with *every* those of all
        branches, children before parents."""
        if not every:
            out, at = [], self.resolve(ref) if ref != "HEAD" or self.head else None
            while at:
                c = self.read_commit(at)
                out.append({"commit": at, **c})
                at = c["parents"][0] if c["parents"] else None
            return out
        seen: dict[str, dict] = {}
        todo = list(self.refs["heads"].values())
        while todo:
            at = todo.pop()
            if at not in seen:
                seen[at] = self.read_commit(at)
                todo += seen[at]["parents"]
        children = {c: 0 for c in seen}
        for c in seen.values():
            for p in c["parents"]:
                children[p] += 1
        ready, out = [c for c, n in children.items() if not n], []
        while ready:
            at = max(ready, key=lambda c: (seen[c]["time"], c))
            ready.remove(at)
            out.append({"commit": at, **seen[at]})
            for p in seen[at]["parents"]:
                children[p] -= 1
                if not children[p]:
                    ready.append(p)
        return out

    def _dirty(self) -> bool:
        head = self.head
        return self.workspace.hash != (self.manifest(head).hash if head else Manifest().hash)

    def branch(self, name: str, at: str = "HEAD") -> None:
        r = self.refs
        if name in r["heads"]:
            raise CypherError(f"branch {name} exists")
        r["heads"][name] = self.resolve(at)
        self.files.write_json("refs.json", r)

    def tag(self, name: str, at: str = "HEAD") -> None:
        r = self.refs
        if name in r["tags"]:
            raise CypherError(f"tag {name} exists")
        r["tags"][name] = self.resolve(at)
        self.files.write_json("refs.json", r)

    def delete_ref(self, name: str, kind: str = "heads") -> None:
        r = self.refs
        if name not in r[kind]:
            raise BindError(f"no {name}" + did_you_mean(name, r[kind]))
        if kind == "heads" and r["head"] == name:
            raise CypherError(f"{name} is checked out")
        del r[kind][name]
        self.files.write_json("refs.json", r)

    def checkout(self, ref: str, *, create: bool = False) -> None:
        if self._dirty() or self.merging:
            raise CypherError("the workspace has changes that are not committed")
        if create:
            self.branch(ref)
        cid, r = self.resolve(ref), self.refs
        r["head"], r["detached"] = (ref, False) if ref in r["heads"] else (cid, True)
        self.files.write_json("refs.json", r)
        self._save(self.manifest(cid))

    # -- graphs

    def table(self, t: Table) -> DataFrame:
        return self.store.read(t)

    def graph(self, ref: str | None = None, manifest: Manifest | None = None) -> Graph:
        m = manifest or self.manifest(ref)
        nodes = {}
        for name, d in m.schema["labels"].items():
            t = m.nodes.get(name)
            df = self.table(t) if t else self.spark.createDataFrame([], NODE_DDL + "".join(f", `{k}` string" for k in d["key"]))
            nodes[name] = NodeTable(name, df, tuple(d["key"]))
        rels = []
        for name, t in m.edges.items():
            rtype, src, dst = json.loads(name)
            df = self.table(t)
            rels.append(RelTable(rtype, src, dst, df.withColumn(EID, F.to_json(F.array(SRC, DST, DISC))).drop(DISC), m.schema["relationship_types"].get(rtype, {}).get("discriminator")))
        for rtype in m.schema["relationship_types"]:
            if not any(json.loads(n)[0] == rtype for n in m.edges) and nodes:
                ends = next(iter(nodes))
                rels.append(RelTable(rtype, ends, ends, self.spark.createDataFrame([], f"{SRC} string, {DST} string, {EID} string")))
        return Graph(self.spark, nodes, rels)

    # -- schema

    def declare_label(self, name: str, key: Iterable[str] = (), **how) -> None:
        m = self.workspace
        new, old, t = S.label(list(key), **how), m.schema["labels"].get(name), m.nodes.get(name)
        if t is not None and t.rows:
            if old and old["key"] != new["key"]:
                raise CypherError(f"the key of {name} can't change while it has nodes")
            df = self.table(t)
            found = S.contradictions(df, new["types"], name) + S.breaches(df, new, name, KEY)
            if found:
                raise S.ConstraintError(found)
        m.schema["labels"][name] = new
        self.save(m)

    def declare_relationship(self, name: str, **how) -> None:
        m = self.workspace
        new, old = S.relationship(**how), m.schema["relationship_types"].get(name)
        found = []
        for n, t in m.edges.items():
            if json.loads(n)[0] == name and t.rows:
                if old and old["discriminator"] != new["discriminator"]:
                    raise CypherError(f"the discriminator of {name} can't change while it has relationships")
                df = self.table(t)
                found += S.contradictions(df, new["types"], name) + S.breaches(df, new, name, SRC)
        if found:
            raise S.ConstraintError(found)
        m.schema["relationship_types"][name] = new
        self.save(m)

    def declare_index(self, name: str, label: str, props: list[str]) -> None:
        """Indexes are kept as declared; scans prune by sorted keys and column statistics."""
        m = self.workspace
        if label not in m.schema["labels"]:
            raise BindError(f"unknown label {label}" + did_you_mean(label, m.schema["labels"]))
        m.schema["indexes"][name] = {"label": label, "properties": list(props)}
        self.save(m)

    def apply_schema(self, document: dict) -> list[str]:
        """Declare all of ``{labels, relationship_types, indexes}``; the plan of what changed."""
        plan, old = [], self.workspace.schema
        for name, d in document.get("labels", {}).items():
            if old["labels"].get(name) != S.label(**d):
                plan.append(f"{'change' if name in old['labels'] else 'declare'} label {name}")
                self.declare_label(name, **d)
        for name, d in document.get("relationship_types", {}).items():
            if old["relationship_types"].get(name) != S.relationship(**d):
                plan.append(f"{'change' if name in old['relationship_types'] else 'declare'} relationship type {name}")
                self.declare_relationship(name, **d)
        for name, d in document.get("indexes", {}).items():
            if old["indexes"].get(name) != d:
                plan.append(f"declare index {name}")
                self.declare_index(name, d["label"], d["properties"])
        return plan

    # -- changing rows (of a manifest that is not saved yet)

    def put_nodes(self, m: Manifest, label: str, df: DataFrame, *, new_only: bool = False) -> None:
        """Put rows with the label's key columns, properties and, if there are
        any, secondary labels in ``_labels``.  Keys must be present and unique
        in *df*; with *new_only* they may not exist before."""
        d = m.schema["labels"].get(label)
        if d is None:
            raise BindError(f"unknown label {label}" + did_you_mean(label, m.schema["labels"]))
        missing = [k for k in d["key"] if k not in df.columns]
        if missing:
            raise CypherError(f"no key {', '.join(missing)} for {label}")
        if LABELS not in df.columns:
            df = df.withColumn(LABELS, F.lit(None).cast("array<string>"))
        old = m.nodes.get(label)
        df = S.stored(df.drop(KEY), d["types"], old.type if old else None, label)
        for f in df.schema.fields:
            if f.name in d["key"] and f.dataType.simpleString() not in ("string", "bigint", "boolean", "double"):
                raise CypherError(f"{f.dataType.simpleString()} can't be a key of {label}")
        df = df.select(key_text([F.col(f"`{k}`") for k in d["key"]]).alias(KEY), *[F.col(f"`{x}`") for x in df.columns])
        self._unique(df, [KEY], f"node {label}", self.table(old) if new_only and old else None)
        found = S.breaches(df, {"required": d["required"]}, label, KEY)
        if found:
            raise S.ConstraintError(found)
        m.nodes[label] = self.store.apply(old, df) if old else self.store.load(df, (KEY,))
        if d["unique"]:
            found = S.breaches(self.table(m.nodes[label]), {"unique": d["unique"]}, label, KEY)
            if found:
                raise S.ConstraintError(found)

    def put_edges(self, m: Manifest, rtype: str, src: str, dst: str, df: DataFrame, *, new_only: bool = False, declare: bool = False) -> None:
        """Put rows with ``_src`` and ``_dst`` (keys of nodes as text, which must
        exist), properties and the discriminator under its declared name."""
        d = m.schema["relationship_types"].get(rtype)
        if d is None:
            if not declare:
                raise BindError(f"unknown relationship type {rtype}" + did_you_mean(rtype, m.schema["relationship_types"]))
            d = m.schema["relationship_types"][rtype] = S.relationship()
        name = edge_name(rtype, src, dst)
        old, disc = m.edges.get(name), d["discriminator"]
        if disc is not None and disc in df.columns:
            df = df.withColumn(DISC, F.coalesce(F.col(f"`{disc}`").cast("string"), F.lit("")))
        elif DISC not in df.columns:
            df = df.withColumn(DISC, F.lit(""))
        df = S.stored(df, d["types"], old.type if old else None, rtype)
        self._unique(df, list(EDGE_KEY), f"relationship {rtype}", self.table(old) if new_only and old else None)
        found = S.breaches(df, {"required": d["required"]}, rtype, SRC)
        for end, label in ((SRC, src), (DST, dst)):
            t = m.nodes.get(label)
            ids = df.select(F.col(end).alias(KEY)).distinct()
            lost = ids if t is None else ids.join(self.table(t).select(KEY), KEY, "left_anti")
            found += [f"{rtype} refers to {label} {r[0]}, which does not exist" for r in lost.limit(5).collect()]
        if found:
            raise S.ConstraintError(found)
        m.edges[name] = self.store.apply(old, df) if old else self.store.load(df, EDGE_KEY)

    def _unique(self, df: DataFrame, keys: list[str], what: str, old: DataFrame | None) -> None:
        none = df.filter(" or ".join(f"{k} is null" for k in keys)).limit(1).collect()
        if none:
            raise CypherError(f"a {what} has no key")
        twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(5).collect()
        if old is not None:
            twice = twice or df.select(*keys).join(old.select(*keys), keys, "left_semi").limit(5).collect()
        if twice:
            raise CypherError(f"{what} exists twice: {[tuple(r)[: len(keys)] for r in twice]}")

    def delete_edges(self, m: Manifest, name: str, keys: DataFrame) -> None:
        m.edges[name] = self.store.apply(m.edges[name], deletes=keys.select(*EDGE_KEY))

    def delete_nodes(self, m: Manifest, label: str, keys: DataFrame, *, detach: bool = False) -> None:
        """Delete nodes; their relationships too (*detach*) or only if they have none."""
        keys = keys.select(KEY).distinct()
        for name, t in list(m.edges.items()):
            _, src, dst = json.loads(name)
            for end, at in ((SRC, src), (DST, dst)):
                if at != label:
                    continue
                df = self.table(m.edges[name])
                hit = df.join(keys.select(F.col(KEY).alias(end)), end, "left_semi")
                if detach:
                    self.delete_edges(m, name, hit)
                elif not hit.isEmpty():
                    raise CypherError(f"{label} {hit.head()[end]} still has relationships; DETACH DELETE deletes them too")
        m.nodes[label] = self.store.apply(m.nodes[label], deletes=keys)

    def rekey(self, label: str, old: DataFrame, new_key: dict[str, Column]) -> None:
        """Give nodes (rows of *old* by ``_k``) other keys, and their
        relationships with them, in one step.  *new_key*: key columns over the rows of the label."""
        m = self.workspace
        key = m.schema["labels"][label]["key"]
        rows = self.table(m.nodes[label]).join(old.select(KEY), KEY, "left_semi")
        moved = rows.withColumns(new_key)
        names = moved.select(F.col(KEY).alias("was"), key_text([F.col(f"`{k}`") for k in key]).alias("now"))
        ends = {}
        for name, t in m.edges.items():
            rtype, src, dst = json.loads(name)
            df = self.table(t)
            for end, at in ((SRC, src), (DST, dst)):
                if at == label:
                    df = df.join(names.select(F.col("was").alias(end), F.col("now").alias("__now")), end, "left").withColumn(end, F.coalesce("__now", end)).drop("__now")
            if label in (src, dst):
                ends[name] = (rtype, src, dst, df)
        m.nodes[label] = self.store.apply(m.nodes[label], deletes=rows.select(KEY))
        self.put_nodes(m, label, moved.drop(KEY), new_only=True)
        for name, (rtype, src, dst, df) in ends.items():
            self._unique(df, list(EDGE_KEY), f"relationship {rtype}", None)
            m.edges[name] = self.store.load(df, EDGE_KEY)
        self.save(m)

    def rename_relationship(self, old: str, new: str, *, merge: bool = False) -> None:
        """Give a type another name; where both have the same relationship it is
        refused, or the one of the new name stays (*merge*)."""
        m = self.workspace
        if old not in m.schema["relationship_types"]:
            raise BindError(f"unknown relationship type {old}" + did_you_mean(old, m.schema["relationship_types"]))
        for name in [n for n in m.edges if json.loads(n)[0] == old]:
            _, src, dst = json.loads(name)
            there = edge_name(new, src, dst)
            df = self.table(m.edges.pop(name))
            if there in m.edges:
                other = self.table(m.edges[there])
                clash = df.join(other.select(*EDGE_KEY), list(EDGE_KEY), "left_semi")
                if not merge and not clash.isEmpty():
                    raise CypherError(f"{new} has relationships of {old} already")
                m.edges[there] = self.store.apply(m.edges[there], df.join(other.select(*EDGE_KEY), list(EDGE_KEY), "left_anti"))
            else:
                m.edges[there] = self.store.load(df, EDGE_KEY)
        was = m.schema["relationship_types"].pop(old)
        m.schema["relationship_types"].setdefault(new, was)
        self.save(m)

    # -- differences and merges

    def diff(self, a: str | None, b: str | None = None) -> DataFrame:
        """``kind`` (node, relationship), ``label`` (or type), ``key``, ``change,
        properties, before, after`` between two versions (null: the workspace)."""
        return self.diff_manifests(self.manifest(a), self.manifest(b))

    def diff_manifests(self, x: Manifest, y: Manifest) -> DataFrame:
        parts = []
        for kind, old, new in (("node", x.nodes, y.nodes), ("relationship", x.edges, y.edges)):
            for name in sorted({*old, *new}):
                a, b = old.get(name), new.get(name)
                if a is not None and b is not None and a.hash == b.hash:
                    continue
                keys = list((a or b).keys)
                found = diff_tables(*self.store.differing(a, b), keys)
                label = name if kind == "node" else json.loads(name)[0]
                key = F.col(KEY) if kind == "node" else F.to_json(F.array(*keys))
                parts.append(found.select(F.lit(kind).alias("kind"), F.lit(label).alias("label"), key.alias("key"), "change", "properties", "before", "after"))
        if not parts:
            return self.spark.createDataFrame([], "kind string, label string, key string, change string, properties array<string>, before map<string,string>, after map<string,string>")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def blame(self, label: str, key: str, ref: str = "HEAD") -> list[dict]:
        """The commits along first parents that changed a node, newest first.
        Versions that share the node's bucket are not read."""
        history = self.log(ref)
        tables = [self.manifest(c["commit"]).nodes.get(label) for c in history] + [None]
        from graphloam.version.tables import bucket_of, row_text

        states: dict = {}

        def state(t: Table | None):
            if t is None:
                return None
            if t.n not in states:
                states[t.n] = self.spark.createDataFrame([(key,)], f"{KEY} string").select(bucket_of((KEY,), t.n)).head()[0]
            own = dict(t.buckets).get(states[t.n])
            if own is None:
                return None
            if own not in states:
                row = self.store.read(t, {states[t.n]}).filter(F.col(KEY) == key)
                states[own] = (row.select(row_text(row.columns)).head() or [None])[0]
            return states[own]

        return [{"label": label, "key": key, "commit": c["commit"], "subject": c["message"].partition("\n")[0]} for c, t, older in zip(history, tables, tables[1:]) if state(t) != state(older)]

    def merge_base(self, a: str, b: str) -> str | None:
        """The latest common ancestor that is an ancestor of no other one."""
        above = self._ancestors
        common = above(self.resolve(a)) & above(self.resolve(b))
        best = [c for c in common if not any(c != d and c in above(d) for d in common)]
        return max(best, key=lambda c: (self.read_commit(c)["time"], c), default=None)

    def _ancestors(self, c: str) -> set[str]:
        seen, todo = set(), [c]
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += self.read_commit(at)["parents"]
        return seen

    def merge(self, ref: str, message: str | None = None) -> str:
        """``up to date``, ``fast forward``, ``merged`` (and committed) or
        ``conflicts`` (the workspace holds what merged; see ``conflicts``)."""
        if self._dirty() or self.merging:
            raise CypherError("the workspace has changes that are not committed")
        ours, theirs = self.head, self.resolve(ref)
        if ours is None:
            raise CypherError("nothing committed to merge into")
        if theirs in self._ancestors(ours):
            return "up to date"
        r = self.refs
        if ours in self._ancestors(theirs):
            self._advance(r, theirs)
            self.files.write_json("refs.json", r)
            self._save(self.manifest(theirs))
            return "fast forward"
        base = self.merge_base(ours, theirs)
        m, conflicts = self.merge_manifests(self.manifest(base) if base else Manifest(), self.manifest(ours), self.manifest(theirs))
        breaches = self.violations(m, self.manifest(base) if base else Manifest())
        merging = {"base": base, "ours": ours, "theirs": theirs, "conflicts": {k: t.to_json() for k, t in conflicts.items()}, "breaches": breaches}
        if not conflicts and not breaches:
            merging["conflicts"] = {}
            self._save(m, merging)
            self.commit(message or f"Merge {ref}")
            return "merged"
        self._save(m, merging)
        return "conflicts"

    def merge_manifests(self, base: Manifest, ours: Manifest, theirs: Manifest) -> tuple[Manifest, dict[str, Table]]:
        """The merged tables, and tables of conflicts by kind and name."""
        out, conflicts = Manifest(), {}
        for part in ("labels", "relationship_types", "indexes"):
            b, o, t = (x.schema[part] for x in (base, ours, theirs))
            for name in sorted({*b, *o, *t}):
                x, y, z = b.get(name), o.get(name), t.get(name)
                chosen = y if y == z or z == x else z if y == x else None
                if chosen is None and not (y == z or z == x or y == x):
                    row = [(name, *[None if v is None else json.dumps(v, sort_keys=True) for v in (x, y, z)])]
                    df = self.spark.createDataFrame(row, f"{KEY} string, base string, ours string, theirs string").withColumn("property", F.lit(None).cast("string"))
                    conflicts[json.dumps(["schema", f"{part}.{name}"])] = self.store.load(df, (KEY,), 1)
                    chosen = y or x or z
                if chosen is not None:
                    out.schema[part][name] = chosen
        for kind, mine in (("nodes", out.nodes), ("edges", out.edges)):
            b, o, t = (getattr(x, kind) for x in (base, ours, theirs))
            for name in sorted({*b, *o, *t}):
                x, y, z = b.get(name), o.get(name), t.get(name)
                hashes = [v.hash if v is not None else None for v in (x, y, z)]
                if hashes[1] == hashes[2] or hashes[2] == hashes[0]:
                    chosen = y
                elif hashes[1] == hashes[0]:
                    chosen = z
                else:
                    keys = list((y or z).keys)
                    found = self.merge_tables(x, y, z, keys)
                    chosen = self.store.load(found.records, tuple(keys))
                    clash = self.store.load(found.conflicts, tuple(keys))
                    if clash.rows:
                        conflicts[json.dumps([kind, name])] = clash
                if chosen is not None:
                    mine[name] = chosen
        return out, conflicts

    def merge_tables(self, x: Table | None, y: Table | None, z: Table | None, keys: list[str]) -> Merged:
        read = lambda t: self.table(t) if t is not None else self.spark.createDataFrame([], (x or y or z).type)
        return merge_tables(read(x), read(y), read(z), keys, sets=(LABELS,) if keys == [KEY] else ())

    def conflicts(self) -> DataFrame:
        """``kind, label, key, property, base, ours, theirs`` of the merge in
        progress: cells that clash; once these are resolved, breaches of
        constraints that the merge brought in, as ``property`` null and the breach in ``ours``."""
        ddl = "kind string, label string, key string, property string, base string, ours string, theirs string"
        merging = self.merging
        parts = []
        for name, t in (merging or {}).get("conflicts", {}).items():
            kind, own = json.loads(name)
            t = Table.from_json(t)
            label = json.loads(own)[0] if kind == "edges" else own
            key = F.to_json(F.array(*t.keys)) if kind == "edges" else F.col(KEY)
            parts.append(self.table(t).select(F.lit({"nodes": "node", "edges": "relationship"}.get(kind, kind)).alias("kind"), F.lit(label).alias("label"), key.alias("key"), "property", "base", "ours", "theirs"))
        if not parts and merging:
            found = self.violations(self.workspace, self.manifest(merging["base"]) if merging["base"] else Manifest())
            return self.spark.createDataFrame([("breach", None, None, None, None, b, None) for b in found], ddl)
        out = self.spark.createDataFrame([], ddl)
        for p in parts:
            out = out.unionByName(p)
        return out

    def resolve_all(self, side: str) -> None:
        """Settle all conflicts by ``ours`` or ``theirs``."""
        merging, m = self.merging, self.workspace
        if not merging:
            raise CypherError("no merge in progress")
        pick = self.manifest(merging[side])
        for name, t in merging["conflicts"].items():
            kind, own = json.loads(name)
            if kind == "schema":
                part, _, key = own.partition(".")
                value = pick.schema[part].get(key)
                m.schema[part].pop(key, None) if value is None else m.schema[part].update({key: value})
                continue
            tables, theirs = (getattr(x, kind) for x in (m, pick))
            clash = self.table(Table.from_json(t))
            keys = list(Table.from_json(t).keys)
            here, there = self.table(tables[own]), self.table(theirs[own]) if own in theirs else None
            whole = clash.filter("property is null").select(*keys)
            cells = clash.filter("property is not null").groupBy(*keys).agg(F.collect_set("property").alias("__p"))
            gone = whole if there is None else whole.join(there.select(*keys), keys, "left_anti")
            puts = None
            if there is not None:
                cols = [x for x in here.columns if x not in keys]
                fixed = here.join(cells, keys).alias("h").join(there.alias("t"), keys, "left")
                have = set(there.columns)
                fixed = fixed.select(*keys, *[(F.when(F.array_contains("h.__p", c), F.col(f"t.`{c}`")).otherwise(F.col(f"h.`{c}`")) if c in have else F.when(~F.array_contains("h.__p", c), F.col(f"h.`{c}`"))).alias(c) for c in cols])
                puts = fixed.unionByName(there.join(whole, keys, "left_semi"), allowMissingColumns=True)
            tables[own] = self.store.apply(tables[own], puts, gone)
        merging["conflicts"] = {}
        self._save(m, merging)

    def abort(self) -> None:
        merging = self.merging
        if not merging:
            raise CypherError("no merge in progress")
        self._save(self.manifest(merging["ours"]))

    # -- integrity

    def violations(self, m: Manifest, since: Manifest | None = None) -> list[str]:
        """Breaches of constraints and dangling ends; with *since* only in
        tables or under definitions that are not the same there."""
        found, old = [], since or Manifest()
        changed = {n for n, t in m.nodes.items() if since is None or n not in old.nodes or old.nodes[n].hash != t.hash}
        for name, t in m.nodes.items():
            d = m.schema["labels"].get(name)
            if d and (name in changed or d != old.schema["labels"].get(name)):
                df = self.table(t)
                found += S.contradictions(df, d["types"], name) + S.breaches(df, d, name, KEY)
        for name, t in m.edges.items():
            rtype, src, dst = json.loads(name)
            same = since is not None and name in old.edges and old.edges[name].hash == t.hash
            df = self.table(t)
            d = m.schema["relationship_types"].get(rtype)
            if d and not (same and d == old.schema["relationship_types"].get(rtype)):
                found += S.contradictions(df, d["types"], rtype) + S.breaches(df, d, rtype, SRC)
            for end, label in ((SRC, src), (DST, dst)):
                if same and label not in changed and label in m.nodes:
                    continue
                ids = df.select(F.col(end).alias(KEY)).distinct()
                lost = ids if label not in m.nodes else ids.join(self.table(m.nodes[label]).select(KEY), KEY, "left_anti")
                found += [f"{rtype} refers to {label} {r[0]}, which does not exist" for r in lost.limit(5).collect()]
        return found

    def validate(self, m: Manifest) -> None:
        found = self.violations(m)
        if found:
            raise S.ConstraintError(found)

    def fsck(self, ref: str | None = None) -> list[str]:
        """What is wrong with a version: files that are missing or hold other
        rows than the manifest says, keys that come twice, breaches."""
        m, found = self.manifest(ref), []
        for kind in ("nodes", "edges"):
            for name, t in getattr(m, kind).items():
                lost = [b[0] for _, b in t.buckets if not self.files.exists(b[0])]
                found += [f"{name}: {x} is missing" for x in lost]
                if lost:
                    continue
                df = self.table(t)
                if self.store.hash(df, t.keys) != t.hash:
                    found.append(f"{name}: rows differ from the manifest")
                if not df.groupBy(*t.keys).count().filter("count > 1").isEmpty():
                    found.append(f"{name}: a key comes twice")
        return found if found else self.violations(m)

    def gc(self) -> int:
        """Delete folders that no commit and not the workspace refers to."""
        live = set()
        for m in [self.workspace, *[Manifest.from_json(self.files.json(f"manifests/{f}")) for f in self.files.list("manifests")]]:
            live |= {b[0].rsplit("/", 1)[0] for t in (*m.nodes.values(), *m.edges.values()) for _, b in t.buckets}
        merging = self.merging or {}
        live |= {b[0].rsplit("/", 1)[0] for t in merging.get("conflicts", {}).values() for _, b in Table.from_json(t).buckets}
        dead = [f for f in self.files.list("data") if f"data/{f}" not in live]
        for f in dead:
            self.files.delete(f"data/{f}")
        return len(dead)

    def migrate(self, transform) -> dict[str, str]:
        """Rewrite history: *transform* maps a manifest to another; commits keep
        their messages, times and shape.  New ids by old ones."""
        new: dict[str, str] = {}
        for c in reversed(self.log(every=True)):
            m = transform(self.manifest(c["commit"]))
            self.files.write_json(f"manifests/{m.hash}.json", m.to_json())
            body = {k: c[k] for k in ("message", "author", "time", "trailers")} | {"manifest": m.hash, "parents": [new[p] for p in c["parents"]]}
            cid = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
            self.files.write_json(f"commits/{cid}.json", body)
            new[c["commit"]] = cid
        r = self.refs
        for kind in ("heads", "tags"):
            r[kind] = {n: new.get(c, c) for n, c in r[kind].items()}
        r["head"] = new.get(r["head"], r["head"])
        self.files.write_json("refs.json", r)
        if self.head:
            self._save(self.manifest("HEAD"))
        return new
