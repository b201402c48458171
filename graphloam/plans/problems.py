"""Queries for the data problems 1 to 5 (core)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloam.operators.history import history
from graphloam.operators.orphans import orphans, report
from graphloam.operators.quarantine import parse_endpoints, parse_lines
from graphloam.operators.reconcile import compare_copies
from graphloam.operators.snapshots import snapshot_changes
from graphloam.sources.tables import table

NODE = ["label", "node_key"]
HOST_STATE = ["os", "criticality", "decommissioned", "rack", "secondary_labels"]
#: The properties of an edge that name a node, and its label.
REFERRING = {"via_host": "Host", "bundled_in": "Software", "cert_serial": "Certificate", "vendor": "Supplier"}
PEERS = ("peers", "Host")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found = history(table(spark, sf, "node_record"), table(spark, sf, "log_entry"), NODE, with_properties=False)
    return found.select(*NODE, "valid_from_id", "valid_to_id")


def p1_history(spark: SparkSession, sf: str) -> DataFrame:
    """The same versions with their properties and times."""
    found = history(table(spark, sf, "node_record"), table(spark, sf, "log_entry"), NODE)
    props = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("properties"))))
    return found.select(*NODE, "valid_from", "valid_to", props.alias("properties"))


def _lines(spark: SparkSession, sf: str, **how) -> DataFrame:
    return parse_lines(table(spark, sf, "import_line"), table(spark, sf, "import_feed"), **how)


def _specs(spark: SparkSession, sf: str, **how) -> DataFrame:
    return parse_endpoints(table(spark, sf, "endpoint_spec"), table(spark, sf, "label_def"), **how)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [p.filter("reason is not null").select(F.lit(t).alias("tbl"), F.col("id").alias("row_id")) for t, p in (("import_line", _lines(spark, sf, with_values=False)), ("endpoint_spec", _specs(spark, sf, with_values=False)))]
    return parts[0].unionAll(parts[1]).distinct()


def p2_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """Sums over the typed cells of the lines that load, by feed and column."""
    lines = table(spark, sf, "import_line").select(F.col("line_id").alias("id"), "feed")
    cells = _lines(spark, sf).filter("reason is null").join(lines, "id").select("feed", F.explode("value").alias("column", "cell"))
    return cells.groupBy("feed", "column").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("cell.int").cast("decimal(38,0)")).cast("string").alias("int_sum"), F.count_if(F.col("cell.bool")).alias("n_true"), F.sum(F.length("cell.text")).alias("text_length")
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return compare_copies(table(spark, sf, "merge_copy")).select("label", "rec_key", "prop", "kind")


def _import_refs(imports: DataFrame) -> DataFrame:
    end = lambda c: F.struct(F.lit(c).alias("ref_field"), F.col(f"{c}.label").alias("label"), F.when(F.size(f"{c}.key") == 1, F.col(f"{c}.key")[0]).otherwise(F.to_json(f"{c}.key")).alias("node_key"))
    each = imports.filter("kind = 'edge'").select(F.lit("import_record").alias("tbl"), "period", "rec_id", "recorded_at", F.explode(F.array(end("src"), end("dst"))).alias("r"))
    return each.select("tbl", "period", "rec_id", "recorded_at", "r.ref_field", "r.label", "r.node_key")


def _edge_refs(edges: DataFrame) -> DataFrame:
    props = F.col("properties")
    one = [F.array(F.struct(F.lit(k).alias("ref_field"), F.lit(v).alias("label"), props[k].alias("node_key"))) for k, v in REFERRING.items()]
    name, label = PEERS
    listed = F.coalesce(F.from_json(props[name], "array<string>"), F.array(props[name]))  # an unreadable list is one key
    many = F.transform(listed, lambda x: F.struct(F.lit(name).alias("ref_field"), F.lit(label).alias("label"), x.alias("node_key")))
    refs = F.filter(F.concat(*one, many), lambda r: r["node_key"].isNotNull())
    each = edges.select(F.lit("edge_record").alias("tbl"), "period", F.col("edge_id").alias("rec_id"), "recorded_at", F.explode(refs).alias("r"))
    return each.select("tbl", "period", "rec_id", "recorded_at", "r.ref_field", "r.label", "r.node_key")


def _orphans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orphans of both tables, direct and inherited, and all records."""
    refs = _import_refs(table(spark, sf, "import_record")).unionByName(_edge_refs(table(spark, sf, "edge_record")))
    records, links = _deliveries(spark, sf)
    found = orphans(refs, table(spark, sf, "graph_node"), NODE, links, at="recorded_at", begins="created_at", ends="deleted_at")
    return found.withColumnRenamed("node_key", "ref_key"), records


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Level 0 of the cascade: the references that have no target themselves."""
    found, _ = _orphans(spark, sf)
    return found.filter("kind = 'direct'").select("tbl", "period", "rec_id", "ref_field", "ref_key").distinct()


def _deliveries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Records of both tables, and the foreign keys from a stored edge to every
    import row that brought the same relationship (its discriminator too, null
    being one) at that time or before."""
    imports, edges = table(spark, sf, "import_record"), table(spark, sf, "edge_record")
    records = imports.select(F.lit("import_record").alias("tbl"), "rec_id", "period").unionAll(edges.select(F.lit("edge_record"), "edge_id", "period"))
    ends = ["rtype", "src_label", "src_key", "dst_label", "dst_key"]
    named = [*ends, F.col("discriminator").isNotNull().alias("told"), F.coalesce("discriminator", F.lit("")).alias("disc")]
    brought = imports.filter("kind = 'edge'").withColumns({"src_label": F.col("src.label"), "src_key": F.to_json("src.key"), "dst_label": F.col("dst.label"), "dst_key": F.to_json("dst.key")})
    brought = brought.select(*named, F.col("recorded_at").alias("brought_at"), F.col("rec_id").alias("parent_id")).distinct()
    stored = edges.withColumns({"src_key": F.to_json(F.array("src_key")), "dst_key": F.to_json(F.array("dst_key"))}).select(*named, "recorded_at", F.col("edge_id").alias("child_id"))
    links = stored.join(brought, [*ends, "told", "disc"]).filter("brought_at <= recorded_at")
    return records, links.select(F.lit("edge_record").alias("child_tbl"), "child_id", F.lit("import_record").alias("parent_tbl"), "parent_id")


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans per table and period, direct and inherited down the foreign keys."""
    found, records = _orphans(spark, sf)
    direct = found.filter("kind = 'direct'").select("tbl", "period", "rec_id", "ref_field", "ref_key").distinct()
    return report(direct, found.select("tbl", "rec_id", "kind").distinct(), records)


def _host_changes(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_changes(table(spark, sf, "host_snapshot"), "hostname", "snapshot_no", HOST_STATE, sets=("secondary_labels",), delivered="delivered_at")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _host_changes(spark, sf).select("snapshot_no", "hostname", "change")


def p5_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Number of changes of each kind and column between consecutive snapshots."""
    changed = F.explode_outer("changed").alias("column")
    return _host_changes(spark, sf).select("snapshot_no", "change", changed).groupBy("snapshot_no", "change", "column").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p1_found, p1_history, p2_found, p2_loaded, p3_found, p4_found, p4_report, p5_found, p5_diff)}

_P1 = """
with c as (select id, min(committed_at) ts from log_entry group by id),
s as (
  select r.label, r.node_key, c.ts, c.id, r.op,
    case when r.op = 'put' then (select list(k || chr(1) || (r.properties[k]) order by k) from (select unnest(map_keys(r.properties)) k) where r.properties[k] is not null) end st,
    row_number() over (partition by r.label, r.node_key, c.ts order by r.arrived_at desc) n
  from node_record r join c on r.commit_id = c.id),
o as (select *, lag(op) over w pop, lag(st) over w pst from s where n = 1 window w as (partition by label, node_key order by ts)),
b as (select *, (op = 'delete' and pop is not distinct from 'put') or (op = 'put' and (pop is distinct from 'put' or pst is distinct from st)) cut from o),
e as (select *, lead(id) over w nid, lead(ts) over w nat from b where cut window w as (partition by label, node_key order by ts))
"""
_SETS = "list_sort(list_distinct(secondary_labels))"
_P5 = f"""
with d as (select snapshot_no, hostname, os, criticality, decommissioned, rack, {_SETS} sl,
    row_number() over (partition by snapshot_no, hostname order by delivered_at desc) n from host_snapshot),
s as (select *, dense_rank() over (order by snapshot_no) i from d where n = 1),
no as (select distinct i, snapshot_no from s),
f as (select coalesce(b.i, a.i + 1) i, coalesce(b.hostname, a.hostname) hostname, a.hostname ah, b.hostname bh,
    a.os ao, b.os bo, a.criticality ac, b.criticality bc, a.decommissioned ad, b.decommissioned bd, a.rack ar, b.rack br, a.sl al, b.sl bl
  from s a full join s b on a.hostname = b.hostname and b.i = a.i + 1),
g as (select no.snapshot_no, f.*,
    case when ah is null then 'added' when bh is null then 'removed'
      when ao is distinct from bo or ac is distinct from bc or ad is distinct from bd or ar is distinct from br or al is distinct from bl then 'modified' end as change
  from f join no on f.i = no.i where f.i > 1)
"""
_CELL = "(?:\"(?:[^\"]|\"\")*\"|[^\"\\r\\n' || esc || ']*)"
_P2 = f"""
with f as (select *, case when sep in ('|', '.', '*', '+', '?', '^', '$', '(', ')', '[', ']', chr(92)) then chr(92) || sep else sep end esc from import_feed),
l as (select i.line_id, i.raw, f.* from import_line i left join f on i.feed = f.feed),
shaped as (select line_id, raw, sep, esc, column_types,
    regexp_full_match(raw, '(?s){_CELL}(?:' || esc || '{_CELL}){{' || (len(column_names) - 1) || '}}') ok from l),
cells as (select line_id, column_types, regexp_extract_all(sep || raw, '(?s)' || esc || '({_CELL})', 1) c from shaped where ok),
typed as (select line_id, unnest(column_types) t, unnest(c) q from cells),
plain as (select line_id, t, trim(case when q like '"%' then replace(q[2:-2], '""', '"') else q end, ' ') v from typed),
bad as (select distinct line_id from plain where
    (t = 'bool' and v not in ('true', 'false')) or (t = 'int' and (not regexp_full_match(v, '[+-]?[0-9]+') or try_cast(v as bigint) is null))),
lab as (select label, len(key_fields) n from label_def),
es as (select spec_id, spec, position('=' in spec) p from endpoint_spec),
ef as (select spec_id, p, case when p > 0 then spec[:p - 1] end head,
    len(list_filter(list_transform(string_split(spec[p + 1:], ','), lambda x: trim(x)), lambda x: x <> '')) n from es)
select distinct 'import_line' as tbl, line_id as row_id from shaped where ok is distinct from true
union all select 'import_line', line_id from bad
union all select distinct 'endpoint_spec', spec_id from ef left join lab on ef.head = lab.label where ef.p is null or p = 0 or lab.label is null or ef.n <> lab.n
"""
_P3 = """
with r as (select side, label, rec_key, rec::json j, row_number() over (partition by side, label, rec_key order by loaded_at desc) n from merge_copy),
k as (select side, label, rec_key, j, unnest(json_keys(j)) prop from r where n = 1),
v as (select side, label, rec_key, prop, json_type(j, '$."' || prop || '"') jt, json_extract(j, '$."' || prop || '"')::varchar jv, json_extract_string(j, '$."' || prop || '"') js from k),
p as (select side, label, rec_key, prop,
    case when jt in ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') then 'n' || (cast(jv as decimal(38, 15)))::varchar when jt = 'VARCHAR' then 's' || js when jt = 'BOOLEAN' then 'b' || js else 'o' || jv end val
  from v where jt <> 'NULL'),
o as (select distinct label, rec_key from r where side = 'ours'), t as (select distinct label, rec_key from r where side = 'theirs'),
po as (select * from p where side = 'ours'), pt as (select * from p where side = 'theirs')
select label, rec_key, '' as prop, 'only_ours' as kind from o anti join t using (label, rec_key)
union all select label, rec_key, '', 'only_theirs' from t anti join o using (label, rec_key)
union all select coalesce(po.label, pt.label), coalesce(po.rec_key, pt.rec_key), coalesce(po.prop, pt.prop), 'differs'
  from po full join pt on po.label = pt.label and po.rec_key = pt.rec_key and po.prop = pt.prop
  where po.val is distinct from pt.val
    and (coalesce(po.label, pt.label), coalesce(po.rec_key, pt.rec_key)) in (select (label, rec_key) from o)
    and (coalesce(po.label, pt.label), coalesce(po.rec_key, pt.rec_key)) in (select (label, rec_key) from t)
"""
_P4 = """
with ir as (select 'import_record' tbl, period, rec_id, recorded_at, unnest(['src', 'dst']) ref_field, unnest([src.label, dst.label]) label, unnest([src.key[1], dst.key[1]]) ref_key from import_record where kind = 'edge'),
er as (select 'edge_record' tbl, period, edge_id rec_id, recorded_at, unnest(['via_host', 'bundled_in', 'cert_serial', 'vendor']) ref_field, unnest(['Host', 'Software', 'Certificate', 'Supplier']) label,
    unnest([properties['via_host'], properties['bundled_in'], properties['cert_serial'], properties['vendor']]) ref_key from edge_record),
pr as (select 'edge_record' tbl, period, edge_id rec_id, recorded_at, 'peers' ref_field, 'Host' as label, unnest(from_json(properties['peers'], '["VARCHAR"]')) ref_key from edge_record where properties['peers'] is not null),
refs as (select * from ir union all select * from er union all select * from pr),
lost as (select distinct tbl, period, rec_id, ref_field, ref_key from refs where ref_key is not null and not exists (
  select 1 from graph_node g where g.label = refs.label and g.node_key = refs.ref_key and g.created_at <= refs.recorded_at and (g.deleted_at is null or refs.recorded_at < g.deleted_at)))
"""
ORACLE = {
    "p1_history": _P1 + """, v as (select * from e where op = 'put'),
j as (select v.*, (select r.properties from node_record r where r.label = v.label and r.node_key = v.node_key and r.commit_id = v.id and r.op = 'put' order by r.arrived_at desc limit 1) p from v)
select label, node_key, ts as valid_from, nat as valid_to,
  '{' || array_to_string(list_transform(list_sort(list_filter(map_keys(p), lambda k: p[k] is not null)), lambda k: to_json(k)::varchar || ':' || to_json(p[k])::varchar), ',') || '}' as properties from j""",
    "p1_found": _P1 + "select label, node_key, id as valid_from_id, coalesce(nid, '') as valid_to_id from e where op = 'put'",
    "p2_found": _P2,
    "p2_loaded": _P2.partition("lab as (")[0]
    + """good as (select s.line_id, f.feed, f.column_names, f.column_types, regexp_extract_all(f.sep || s.raw, '(?s)' || s.esc || '(""" + _CELL.replace("' || esc || '", "' || s.esc || '") + """)', 1) c
  from shaped s join l on l.line_id = s.line_id join import_feed f on f.feed = l.feed where s.ok and s.line_id not in (select line_id from bad)),
q as (select feed, unnest(column_names) as "column", unnest(column_types) t, unnest(c) q from good),
v as (select *, case when q like '"%' then replace(q[2:-2], '""', '"') else q end v from q)
select feed, "column", count(*) as n, sum(case when t = 'int' then trim(v, ' ')::bigint end)::varchar as int_sum,
  count(case when t = 'bool' and trim(v, ' ') = 'true' then 1 end) as n_true, sum(case when t = 'string' then length(v) end)::bigint as text_length from v group by feed, "column" """,
    "p3_found": _P3,
    "p4_found": _P4 + "select * from lost",
    "p4_report": _P4
    + """, rec as (select distinct 'import_record' tbl, rec_id, period from import_record union all select distinct 'edge_record', edge_id, period from edge_record),
par as (select distinct rtype, src.label sl, src.key[1] sk, dst.label dl, dst.key[1] dk, discriminator di, recorded_at ts, rec_id pid from import_record where kind = 'edge'),
inh as (select distinct e.edge_id rec_id from edge_record e join par on e.rtype = par.rtype and e.src_label = sl and e.src_key = sk and e.dst_label = dl and e.dst_key = dk and e.discriminator is not distinct from di and ts <= e.recorded_at
  where pid in (select rec_id from lost where tbl = 'import_record') and e.edge_id not in (select rec_id from lost where tbl = 'edge_record')),
n as (select tbl, rec_id, count(*) refs from lost group by all)
select rec.tbl, rec.period, count(*) as n_records, coalesce(sum(n.refs), 0)::bigint as n_dangling_refs, count(n.refs) as n_direct, count(inh.rec_id) as n_inherited
from rec left join n using (tbl, rec_id) left join inh on rec.tbl = 'edge_record' and rec.rec_id = inh.rec_id group by rec.tbl, rec.period""",
    "p5_found": _P5 + "select snapshot_no, hostname, change from g where change is not null",
    "p5_diff": _P5
    + """, u as (select snapshot_no, change, unnest(case when change = 'modified' then list_filter([case when ao is distinct from bo then 'os' end, case when ac is distinct from bc then 'criticality' end,
    case when ad is distinct from bd then 'decommissioned' end, case when ar is distinct from br then 'rack' end, case when al is distinct from bl then 'secondary_labels' end], lambda x: x is not null) else [null] end) as "column" from g where change is not null)
select snapshot_no, change, "column", count(*) as n from u group by all""",
}
