"""Cypher queries over the given tables, each with the SQL that must agree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from graphloam.cypher.session import GraphSession
from graphloam.plans import graphs


@dataclass(frozen=True)
class Case:
    cypher: str
    sql: str | None
    params: dict | None = None
    graph: str = "trade"

    def run(self, spark: SparkSession, sf: str) -> DataFrame:
        return GraphSession(graphs.opened(self.graph, spark, sf)).run(self.cypher, self.params)


CASES: dict[str, Case] = {}


def case(name: str, cypher: str, sql: str | None, params: dict | None = None, graph: str = "trade") -> None:
    assert name not in CASES, name
    CASES[name] = Case(cypher, sql, params, graph)


# -- scans and seeks
ALL_NODES = " union all ".join(f"select '{a}' as label from {b}" for a, b in (("Region", "region"), ("Nation", "nation"), ("Customer", "customer"), ("Supplier", "supplier"), ("Part", "part"), ("Order", "orders"), ("Event", "events")))
case("scan_all_nodes", "MATCH (n) RETURN labels(n)[0] AS label, count(*) AS n", f"select label, count(*) as n from ({ALL_NODES}) group by label")
case("scan_label", "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_name AS name, p.p_size AS size", "select p_partkey as k, p_name as name, p_size::bigint as size from part")
case("seek_key", "MATCH (o:Order {o_orderkey: 77}) RETURN o.o_orderkey AS k, o.o_totalprice AS price", "select o_orderkey as k, o_totalprice as price from orders where o_orderkey = 77")
case("seek_index", "MATCH (c:Customer) WHERE c.c_mktsegment = 'BUILDING' RETURN c.c_custkey AS k", "select c_custkey as k from customer where c_mktsegment = 'BUILDING'")
case("seek_composite", "MATCH (o:Order) WHERE o.o_orderstatus = 'F' AND o.o_orderpriority = '1-URGENT' RETURN o.o_orderkey AS k", "select o_orderkey as k from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
case("seek_range", "MATCH (o:Order) WHERE o.o_totalprice >= 1000 AND o.o_totalprice < 50000 RETURN o.o_orderkey AS k, o.o_totalprice AS price", "select o_orderkey as k, o_totalprice as price from orders where o_totalprice >= 1000 and o_totalprice < 50000")
case("expand_out", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_name AS name, o.o_orderkey AS k", "select c_name as name, o_orderkey as k from customer join orders on c_custkey = o_custkey")
case("expand_in", "MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer) RETURN n.n_name AS nation, count(c) AS n", "select n_name as nation, count(*) as n from nation join customer on c_nationkey = n_nationkey group by n_name")
case("expand_undirected", "MATCH (a:Nation)-[:RING]-(b) RETURN a.n_nationkey AS a, b.n_nationkey AS b", "select n_nationkey::bigint as a, ((n_nationkey + 1) % 25)::bigint as b from nation union all select ((n_nationkey + 1) % 25)::bigint, n_nationkey::bigint from nation")
case("expand_multi_type", "MATCH (x)-[r:LIVES_IN|BASED_IN]->(n:Nation) RETURN n.n_name AS nation, type(r) AS t, count(*) AS n", "select n_name as nation, t, count(*) as n from (select c_nationkey k, 'LIVES_IN' t from customer union all select s_nationkey, 'BASED_IN' from supplier) join nation on k = n_nationkey group by n_name, t")
case("expand_any_type", "MATCH (c:Customer)-[r]->(x) RETURN type(r) AS t, labels(x)[0] AS l, count(*) AS n", "select 'PLACED' as t, 'Order' as l, count(*) as n from orders join customer on o_custkey = c_custkey union all select 'LIVES_IN', 'Nation', count(*) from customer union all select 'DID', 'Event', count(*) from events")
case("fn_start_end_node", "MATCH ()-[r:IN_REGION]->() RETURN startNode(r).n_name AS s, endNode(r).r_name AS e", "select n_name as s, r_name as e from nation join region on n_regionkey = r_regionkey")
case("unwind_list", "UNWIND [3, 1, null, 2] AS x RETURN x", "select unnest([3, 1, null, 2])::bigint as x")
case("unwind_range", "UNWIND range(10, 0, -3) AS x RETURN x, x * x AS square", "select x, x * x as square from (select unnest([10, 7, 4, 1])::bigint x)")
case("unwind_null", "UNWIND null AS x RETURN x", "select null::varchar as x where false")
case("unwind_collected", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, collect(n.n_name) AS names UNWIND names AS name RETURN r.r_name AS region, name, size(names) AS n", "select r_name as region, n_name as name, count(*) over (partition by r_regionkey) as n from nation join region on n_regionkey = r_regionkey")

# -- filter, projection
case("filter_basic", "MATCH (p:Part) WHERE p.p_size > 25 AND p.p_retailprice <= 1500.0 RETURN p.p_partkey AS k", "select p_partkey as k from part where p_size > 25 and p_retailprice <= 1500.0")
case("project_exprs", "MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice * 0.5 AS half, o.o_orderkey + 1 AS next, o.o_orderstatus + '-' + o.o_orderpriority AS tag", "select o_orderkey as k, o_totalprice * 0.5 as half, o_orderkey + 1 as next, o_orderstatus || '-' || o_orderpriority as tag from orders")
case("project_star", "MATCH (n:Nation) WITH n.n_name AS b, n.n_nationkey AS a RETURN *", "select n_nationkey::bigint as a, n_name as b from nation")
case("project_default_names", "MATCH (r:Region) RETURN r.r_name, r.r_regionkey + 1", 'select r_name as "r.r_name", (r_regionkey + 1)::bigint as "r.r_regionkey + 1" from region')
case("with_where_after_limit", "MATCH (o:Order) WITH o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k LIMIT 50 WHERE k % 2 = 0 RETURN k, p", "select * from (select o_orderkey as k, o_totalprice as p from orders order by p desc, k limit 50) where k % 2 = 0")
case("with_chain", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) WITH n, count(*) AS customers MATCH (n)-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, sum(customers) AS customers, max(customers) AS most", "select r_name as region, sum(n)::bigint as customers, max(n) as most from (select c_nationkey, count(*) n from customer group by 1) join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name")
case("inline_property_map", "MATCH (o:Order {o_orderstatus: 'O', o_orderpriority: '5-LOW'}) RETURN o.o_orderkey AS k", "select o_orderkey as k from orders where o_orderstatus = 'O' and o_orderpriority = '5-LOW'")
case("inline_rel_map", "MATCH (o:Order)-[r:CONTAINS {l_returnflag: 'R'}]->(p:Part) RETURN p.p_brand AS brand, count(*) AS n, round(sum(r.l_quantity)) AS q", "select p_brand as brand, count(*) as n, round(sum(l_quantity)) as q from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R' group by p_brand")
case("label_predicate", "MATCH (x)-[:LIVES_IN|BASED_IN]->(:Nation) WHERE x:Supplier RETURN count(*) AS n", "select count(*) as n from supplier")
case("pattern_semi", "MATCH (c:Customer) WHERE (c)-[:PLACED]->(:Order) RETURN c.c_custkey AS k", "select c_custkey as k from customer where exists (select 1 from orders where o_custkey = c_custkey)")
case("pattern_anti", "MATCH (c:Customer) WHERE NOT (c)-[:DID]->(:Event) RETURN c.c_custkey AS k", "select c_custkey as k from customer where not exists (select 1 from events where user_id = c_custkey)")
case("pattern_semi_with_map", "MATCH (c:Customer) WHERE (c)-[:PLACED]->(:Order {o_orderstatus: 'P'}) RETURN c.c_custkey AS k", "select c_custkey as k from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
case("pattern_exists_column", "MATCH (c:Customer) RETURN c.c_custkey AS k, (c)-[:DID]->(:Event) AS active, NOT (c)-[:PLACED]->() AS idle", "select c_custkey as k, exists (select 1 from events where user_id = c_custkey) as active, not exists (select 1 from orders where o_custkey = c_custkey) as idle from customer")
case("pattern_in_or", "MATCH (c:Customer) WHERE c.c_acctbal < 0 OR (c)-[:DID]->() RETURN c.c_custkey AS k", "select c_custkey as k from customer where c_acctbal < 0 or exists (select 1 from events where user_id = c_custkey)")
case("is_null", "UNWIND [1, null, 2] AS x RETURN x, x IS NULL AS a, x IS NOT NULL AS b", "select x, x is null as a, x is not null as b from (select unnest([1, null, 2])::bigint x)")
case("compare_ops", "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size = 7 AS a, p.p_size <> 7 AS b, p.p_size < 7 AS c, p.p_size <= 7 AS d, p.p_size > 7.5 AS e, p.p_size >= 7 AS f, p.p_size = 'x' AS g, p.p_size < 'x' AS h", "select p_partkey as k, p_size = 7 as a, p_size <> 7 as b, p_size < 7 as c, p_size <= 7 as d, p_size > 7.5 as e, p_size >= 7 as f, false as g, null::boolean as h from part")
case("compare_chain", "MATCH (p:Part) WHERE 10 < p.p_size <= 20 <> p.p_partkey RETURN p.p_partkey AS k", "select p_partkey as k from part where 10 < p_size and p_size <= 20 and 20 <> p_partkey")
case("compare_nan", "UNWIND [0.0 / 0.0, 1.0] AS x RETURN x = x AS eq, x < 2 AS lt, x > 0 AS gt, x >= x AS ge", "select * from (values (false, false, false, false), (true, true, true, true)) t(eq, lt, gt, ge)")
case("compare_lists", "RETURN [1, null] = [1, null] AS a, [1, null] = [2, null] AS b, [1, 2] = [1.0, 2] AS c, [1] = [1, 2] AS d, {a: 1} = {a: 1} AS e, {a: null} = {a: 1} AS f", "select null::boolean as a, false as b, true as c, false as d, true as e, null::boolean as f")
case("boolean_logic", "UNWIND [true, false, null] AS a UNWIND [true, false, null] AS b RETURN a, b, a AND b AS x, a OR b AS y, a XOR b AS z, NOT a AS w", "select a, b, a and b as x, a or b as y, a <> b as z, not a as w from (select unnest([true, false, null]) a), (select unnest([true, false, null]) b)")
case("in_list", "MATCH (c:Customer) WHERE c.c_mktsegment IN ['BUILDING', 'MACHINERY', null] RETURN c.c_custkey AS k", "select c_custkey as k from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
case("in_list_nulls", "RETURN 1 IN [1, null] AS a, 2 IN [1, null] AS b, null IN [] AS c, null IN [1] AS d, 1 IN ['a'] AS e, [1] IN [[1], [2]] AS f", "select true as a, null::boolean as b, false as c, null::boolean as d, false as e, true as f")
case("string_predicates", "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_name STARTS WITH 'P' AS a, p.p_name ENDS WITH '7' AS b, p.p_type CONTAINS 'A' AS c, p.p_size CONTAINS '1' AS d", "select p_partkey as k, starts_with(p_name, 'P') as a, ends_with(p_name, '7') as b, contains(p_type, 'A') as c, null::boolean as d from part")
case("parameters", "MATCH (o:Order) WHERE o.o_orderstatus = $status AND o.o_totalprice > $least RETURN o.o_orderkey AS k, $tags[1] AS tag", "select o_orderkey as k, 'b' as tag from orders where o_orderstatus = 'F' and o_totalprice > 1000", {"status": "F", "least": 1000, "tags": ["a", "b"]})
case("case_simple", "MATCH (o:Order) RETURN o.o_orderkey AS k, CASE o.o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS v", "select o_orderkey as k, case o_orderstatus when 'F' then 1 when 'O' then 2 end::bigint as v from orders")
case("case_searched", "MATCH (p:Part) RETURN p.p_partkey AS k, CASE WHEN p.p_size < 10 THEN 'small' WHEN p.p_size < 30 THEN 'medium' ELSE 'large' END AS v", "select p_partkey as k, case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as v from part")
case("skip_limit", "MATCH (p:Part) RETURN p.p_partkey AS k ORDER BY p.p_retailprice DESC, k SKIP 5 LIMIT $n", "select p_partkey as k from part order by p_retailprice desc, k limit 10 offset 5", {"n": 10})
case("order_by", "MATCH (s:Supplier) WITH s ORDER BY s.s_acctbal, s.s_suppkey RETURN s.s_suppkey AS k, s.s_acctbal AS b", "select s_suppkey as k, s_acctbal as b from supplier")
case("order_by_nulls", "UNWIND [2, null, 1] AS x WITH x ORDER BY x DESC LIMIT 2 RETURN x", "select * from (values (null::bigint), (2)) t(x)")
case("topk", "MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k LIMIT 25", "select o_orderkey as k, o_totalprice as p from orders order by p desc, k limit 25")
case("return_distinct", "MATCH (o:Order) RETURN DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p", "select distinct o_orderstatus as s, o_orderpriority as p from orders")
case("distinct_nodes", "MATCH (c:Customer)-[:PLACED]->(:Order {o_orderstatus: 'F'}) WITH DISTINCT c RETURN count(*) AS n, sum(c.c_acctbal) > 0 AS positive", "select count(*) as n, sum(c_acctbal) > 0 as positive from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F')")

# -- joins
case("two_hop", "MATCH (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) RETURN p.p_brand AS brand, count(*) AS n", "select p_brand as brand, count(*) as n from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey group by p_brand")
case("three_hop", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.r_name AS region, o.o_orderpriority AS p, count(*) AS n", "select r_name as region, o_orderpriority as p, count(*) as n from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by all")
case("comma_shared", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation), (c)-[:PLACED]->(o:Order) RETURN n.n_name AS nation, count(o) AS n", "select n_name as nation, count(*) as n from customer join nation on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by n_name")
case("cartesian", "MATCH (r:Region), (n:Nation) RETURN r.r_name AS r, n.n_name AS n", "select r_name as r, n_name as n from region, nation")
case("theta_join", "MATCH (r:Region), (n:Nation) WHERE r.r_regionkey < n.n_nationkey AND r.r_regionkey * 5 >= n.n_nationkey RETURN r.r_name AS r, n.n_name AS n", "select r_name as r, n_name as n from region, nation where r_regionkey < n_nationkey and r_regionkey * 5 >= n_nationkey")
case("value_join", "MATCH (c:Customer), (s:Supplier) WHERE c.c_nationkey = s.s_nationkey AND c.c_mktsegment = 'BUILDING' RETURN s.s_suppkey AS s, count(*) AS n", "select s_suppkey as s, count(*) as n from customer join supplier on c_nationkey = s_nationkey where c_mktsegment = 'BUILDING' group by s_suppkey")
case("triangle", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)<-[:BASED_IN]-(s:Supplier), (c)-[:PLACED]->()-[:SHIPPED_BY]->(s) RETURN n.n_name AS nation, count(*) AS n", "select n_name as nation, count(*) as n from customer join nation on c_nationkey = n_nationkey join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey and s_nationkey = n_nationkey group by n_name")
case("cycle_ring", "MATCH (a:Nation)-[:RING]->(b)-[:RING]->(c), (c)-[:RING*23]->(a) RETURN count(*) AS n", "select 25::bigint as n")
case("bound_rel", "MATCH (n:Nation)-[r:IN_REGION]->(:Region) WITH r MATCH (a)-[r]->(b:Region) RETURN a.n_name AS a, b.r_name AS b", "select n_name as a, r_name as b from nation join region on n_regionkey = r_regionkey")
case("bound_node", "MATCH (n:Nation) WITH n WHERE n.n_regionkey = 2 MATCH (n)<-[:BASED_IN]-(s) RETURN n.n_name AS n, s.s_name AS s", "select n_name as n, s_name as s from nation join supplier on s_nationkey = n_nationkey where n_regionkey = 2")
case("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:DID]->(e:Event) RETURN c.c_custkey AS k, count(e) AS n, sum(e.value) > 0 AS some", "select c_custkey as k, count(event_id) as n, coalesce(sum(value), 0) > 0 as some from customer left join events on user_id = c_custkey group by c_custkey")
case("optional_match_where", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > c.c_acctbal * 20 AND o.o_orderstatus = 'F' RETURN c.c_custkey AS k, count(o) AS n", "select c_custkey as k, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey and o_totalprice > c_acctbal * 20 and o_orderstatus = 'F' group by c_custkey")
case("optional_chain", "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:BASED_IN]-(s:Supplier) WITH n, count(s) AS suppliers OPTIONAL MATCH (n)<-[:LIVES_IN]-(c:Customer) WHERE c.c_acctbal < 0 RETURN n.n_name AS nation, suppliers, count(c) AS debtors", "select n_name as nation, (select count(*) from supplier where s_nationkey = n_nationkey) as suppliers, (select count(*) from customer where c_nationkey = n_nationkey and c_acctbal < 0) as debtors from nation")
case("pattern_comprehension", "MATCH (c:Customer) RETURN c.c_custkey AS k, size([(c)-[:PLACED]->(o) WHERE o.o_orderstatus = 'F' | o.o_orderkey]) AS n", "select c_custkey as k, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F' group by c_custkey")
case("pattern_comprehension_outer", "MATCH (n:Nation) RETURN n.n_name AS nation, size([(n)<-[:LIVES_IN]-(c:Customer) WHERE c.c_custkey > n.n_nationkey * 10 | c.c_name]) AS n", "select n_name as nation, count(c_custkey) as n from nation left join customer on c_nationkey = n_nationkey and c_custkey > n_nationkey * 10 group by n_name")
RING = "select n_nationkey::bigint a, ((n_nationkey + 1) % 25)::bigint b from nation"
case("var_length_bounded", "MATCH (a:Nation)-[:RING*1..3]->(b:Nation) RETURN a.n_name AS a, b.n_name AS b", f"with r as ({RING}) select x.n_name as a, y.n_name as b from nation x, nation y, (select unnest([1, 2, 3]) d) where y.n_nationkey = (x.n_nationkey + d) % 25")
case("var_length_zero", "MATCH (a:Nation)-[:RING*0..2]->(b) RETURN a.n_nationkey AS a, b.n_nationkey AS b", "select n_nationkey::bigint as a, ((n_nationkey + d) % 25)::bigint as b from nation, (select unnest([0, 1, 2]) d)")
case("var_length_exact", "MATCH (a:Nation)-[rs:RING*4]->(b) RETURN a.n_nationkey AS a, b.n_nationkey AS b, size(rs) AS n", "select n_nationkey::bigint as a, ((n_nationkey + 4) % 25)::bigint as b, 4::bigint as n from nation")
case("var_length_unbounded", "MATCH (a:Nation {n_nationkey: 0})-[rs:RING*]->(b) RETURN b.n_name AS b, size(rs) AS n", "select n_name as b, case when n_nationkey = 0 then 25 else n_nationkey end::bigint as n from nation")
case("var_length_undirected", "MATCH (a:Nation)-[:RING*2]-(b) RETURN a.n_nationkey AS a, b.n_nationkey AS b", "select n_nationkey::bigint as a, ((n_nationkey + d) % 25)::bigint as b from nation, (select unnest([2, 23]) d)")
case("var_length_mixed", "MATCH (c:Customer)-[:LIVES_IN|IN_REGION*1..2]->(x) RETURN labels(x)[0] AS l, count(*) AS n", "select 'Nation' as l, count(*) as n from customer union all select 'Region', count(*) from customer")
case("rel_uniqueness", "MATCH (p1:Part)<-[:CONTAINS]-(o:Order)-[:CONTAINS]->(p2:Part) RETURN count(*) AS n", "select sum(n * (n - 1))::bigint as n from (select l_orderkey, count(*) n from lineitem group by 1)")
case("path_length", "MATCH p = (c:Customer)-[:LIVES_IN]->()-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, length(p) AS l, count(*) AS n", "select r_name as r, 2::bigint as l, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name")
case("path_length_variable", "MATCH p = (a:Nation)-[:RING*1..2]->(b) RETURN length(p) AS l, count(*) AS n", "select * from (values (1::bigint, 25::bigint), (2, 25)) t(l, n)")
case("path_nodes", "MATCH p = (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS k, [x IN nodes(p) | labels(x)[0]] AS ls, [x IN relationships(p) | type(x)] AS ts, nodes(p)[1].r_name AS r", "select n_name as k, ['Nation', 'Region'] as ls, ['IN_REGION'] as ts, r_name as r from nation join region on n_regionkey = r_regionkey")

# -- aggregation
case("group_by_implicit", "MATCH (o:Order) RETURN o.o_orderstatus AS s, count(*) AS n, max(o.o_totalprice) AS m", "select o_orderstatus as s, count(*) as n, max(o_totalprice) as m from orders group by 1")
case("agg_count_star", "MATCH (:Order)-[:CONTAINS]->(:Part) RETURN count(*) AS n", "select count(*) as n from lineitem")
case("agg_count", "UNWIND [1, null, 2, 2] AS x RETURN count(x) AS n, count(DISTINCT x) AS d", "select 3::bigint as n, 2::bigint as d")
case("agg_sum", "MATCH (p:Part) RETURN p.p_brand AS b, sum(p.p_size) AS s, round(sum(p.p_retailprice)) AS r", "select p_brand as b, sum(p_size)::bigint as s, round(sum(p_retailprice)) as r from part group by 1")
case("agg_avg", "MATCH (p:Part) RETURN p.p_brand AS b, avg(p.p_size) AS a", "select p_brand as b, avg(p_size) as a from part group by 1")
case("agg_min_max", "MATCH (c:Customer) RETURN c.c_mktsegment AS s, min(c.c_name) AS lo, max(c.c_name) AS hi, min(c.c_acctbal) AS a, max(c.c_acctbal) AS b", "select c_mktsegment as s, min(c_name) as lo, max(c_name) as hi, min(c_acctbal) as a, max(c_acctbal) as b from customer group by 1")
case("agg_collect", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, collect(n.n_nationkey) AS ks RETURN r.r_name AS r, size(ks) AS n, reduce(s = 0, k IN ks | s + k) AS total", "select r_name as r, count(*) as n, sum(n_nationkey)::bigint as total from region join nation on n_regionkey = r_regionkey group by 1")
case("agg_distinct", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN o.o_orderpriority AS p, count(DISTINCT c) AS customers, count(DISTINCT o.o_orderstatus) AS s, sum(DISTINCT c.c_nationkey) AS t, avg(DISTINCT c.c_nationkey) AS a", "select o_orderpriority as p, count(distinct c_custkey) as customers, count(distinct o_orderstatus) as s, sum(distinct c_nationkey)::bigint as t, avg(distinct c_nationkey) as a from customer join orders on o_custkey = c_custkey group by 1")
case("agg_expression", "MATCH (o:Order) RETURN o.o_orderstatus AS s, count(*) * 2 + 1 AS n, size(collect(DISTINCT o.o_orderpriority)) AS d, o.o_orderstatus + toString(count(*)) AS tag ORDER BY count(*) DESC, s LIMIT 10", "select o_orderstatus as s, count(*) * 2 + 1 as n, count(distinct o_orderpriority) as d, o_orderstatus || count(*)::varchar as tag from orders group by 1")
case("agg_having", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(*) AS n WHERE n > 12 RETURN c.c_name AS name, n", "select c_name as name, count(*) as n from customer join orders on o_custkey = c_custkey group by c_custkey, c_name having count(*) > 12")
case("agg_empty", "MATCH (c:Customer) WHERE c.c_custkey < 0 RETURN count(*) AS n, sum(c.c_custkey) AS s, avg(c.c_acctbal) AS a, min(c.c_name) AS m, collect(c.c_name) AS l", "select 0::bigint as n, 0::bigint as s, null::double as a, null::varchar as m, []::varchar[] as l")
case("agg_empty_grouped", "MATCH (c:Customer) WHERE c.c_custkey < 0 RETURN c.c_mktsegment AS s, count(*) AS n", "select 'x' as s, 1::bigint as n where false")

# -- scalar functions
C, P, O, S = ("Customer", "customer", "c_custkey"), ("Part", "part", "p_partkey"), ("Order", "orders", "o_orderkey"), ("Supplier", "supplier", "s_suppkey")


def fn(name: str, of: tuple, cypher: str, sql: str) -> None:
    label, tbl, key = of
    case("fn_" + name, f"MATCH (x:{label}) RETURN x.{key} AS k, {cypher} AS v", f"select {key} as k, {sql} as v from {tbl}")


fn("abs", C, "abs(x.c_acctbal)", "abs(c_acctbal)")
fn("ceil", C, "ceil(x.c_acctbal)", "ceil(c_acctbal)")
fn("floor", C, "floor(x.c_acctbal)", "floor(c_acctbal)")
fn("round", C, "round(x.c_acctbal)", "sign(c_acctbal) * floor(abs(c_acctbal) + 0.5)")
fn("sqrt", P, "sqrt(x.p_size)", "sqrt(p_size)")
fn("sign", C, "sign(x.c_acctbal)", "sign(c_acctbal)::bigint")
fn("coalesce", C, "coalesce(x.nothing, null, x.c_name, 'none')", "c_name")
fn("tostring", O, "toString(x.o_orderkey) + ':' + toString(x.o_totalprice > 1000) + ':' + toString(1.0) + ':' + toString(1e20) + ':' + toString(0.0000001)", "o_orderkey::varchar || ':' || (o_totalprice > 1000)::varchar || ':1.0:100000000000000000000:0.0000001'")
fn("tointeger", P, "toInteger(toString(x.p_size) + '.7') + toInteger(' 5 ') + coalesce(toInteger('abc'), 1) + toInteger(-3.9)", "(p_size + 5 + 1 - 3)::bigint")
fn("tofloat", P, "toFloat(toString(x.p_size)) + coalesce(toFloat('x'), 0.5)", "p_size + 0.5::double")
fn("toboolean", P, "coalesce(toBoolean(CASE WHEN x.p_size > 20 THEN ' True ' WHEN x.p_size > 10 THEN 'false' ELSE 'yes' END), x.p_size = 1)", "case when p_size > 20 then true when p_size > 10 then false else p_size = 1 end")
fn("toupper", C, "toUpper(x.c_name)", "upper(c_name)")
fn("tolower", C, "toLower(x.c_name)", "lower(c_name)")
fn("trim", C, "trim('\\t ' + x.c_name + ' \\n')", "c_name")
fn("ltrim", C, "lTrim('\\t ' + x.c_name + ' ')", "c_name || ' '")
fn("rtrim", C, "rTrim(' ' + x.c_name + ' \\n')", "' ' || c_name")
fn("left", C, "left(x.c_name, 4)", "left(c_name, 4)")
fn("right", C, "right(x.c_name, 3)", "right(c_name, 3)")
fn("substring", C, "substring(x.c_name, 2, 5) + '|' + substring(x.c_name, 3)", "substring(c_name, 3, 5) || '|' || substring(c_name, 4)")
fn("replace", C, "replace(x.c_name, '0', '--')", "replace(c_name, '0', '--')")
fn("split", C, "size(split(x.c_name, '0'))", "len(string_split(c_name, '0'))")
fn("reverse", C, "reverse(x.c_name)", "reverse(c_name)")
fn("size", C, "size(x.c_name) + size([1, 2, 3])", "length(c_name) + 3")
fn("length", C, "length(x.c_name)", "length(c_name)")
fn("head", C, "head([x.c_name, 'b'])", "c_name")
fn("last", C, "last(['a', x.c_name])", "c_name")
fn("tail", P, "tail([1, x.p_size, 3])", "[p_size::bigint, 3]")
fn("range", P, "range(x.p_size, 10, 4)", "case when p_size > 10 then []::bigint[] else range(p_size::bigint, 11, 4) end")
fn("keys", S, "keys(x)", "['s_acctbal', 's_name', 's_nationkey', 's_suppkey']")
fn("properties", S, "properties(x).s_name", "s_name")
fn("labels", S, "labels(x)", "['Supplier']")
case("fn_type", "MATCH (:Nation)-[r]->(x) RETURN type(r) AS t, count(*) AS n", "select 'IN_REGION' as t, count(*) as n from nation union all select 'RING', count(*) from nation")
case("fn_nodes", "MATCH p = (:Nation)-[:RING*2]->() RETURN size(nodes(p)) AS n, count(*) AS c", "select 3::bigint as n, 25::bigint as c")
case("fn_relationships", "MATCH p = (:Nation)-[:RING*1..2]->() RETURN size(relationships(p)) AS n, count(*) AS c", "select * from (values (1::bigint, 25::bigint), (2, 25)) t(n, c)")
case("fn_null_arguments", "RETURN abs(null) AS a, toUpper(null) AS b, size(null) AS c, split(null, ',') AS d, left(null, 1) AS e, head(null) AS f, coalesce(null) AS g", "select null::bigint as a, null::varchar as b, null::bigint as c, null::varchar[] as d, null::varchar as e, null::varchar as f, null::varchar as g")

# -- operators on values
case("quoted_names", "MATCH (`a node`:Region) WITH `a node`.`r_name` AS `odd name` RETURN `odd name` AS `x``y`", 'select r_name as "x`y" from region')
case("literals", "RETURN 0x1F AS a, 0o17 AS b, 1.5e3 AS c, 'it\\'s \\u00e9' AS d, \"q\" AS e, true AS f, null AS g, [1, 2] AS h, -9223372036854775808 AS i", "select 31::bigint as a, 15::bigint as b, 1500.0::double as c, 'it''s é' as d, 'q' as e, true as f, null::varchar as g, [1, 2]::bigint[] as h, (-9223372036854775808)::bigint as i")
case("arith_ops", "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size / 7 AS a, -p.p_size / 7 AS b, -p.p_size % 7 AS c, p.p_size ^ 2 AS d, p.p_size * 1.5 - 1 AS e, p.p_retailprice / 0.0 AS f, 2 + 3 * 4 AS g", "select p_partkey as k, (p_size // 7)::bigint as a, -(p_size // 7)::bigint as b, -(p_size % 7)::bigint as c, pow(p_size, 2) as d, p_size * 1.5::double - 1 as e, 'inf'::double as f, 14::bigint as g from part")
case("string_concat", "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_name + p.p_size AS a, p.p_size + p.p_name AS b, p.p_name + null AS c", "select p_partkey as k, p_name || p_size::varchar as a, p_size::varchar || p_name as b, null::varchar as c from part")
case("list_concat", "MATCH (p:Part) RETURN p.p_partkey AS k, [1] + [p.p_size] AS a, [1] + p.p_size AS b, p.p_size + [1] AS c", "select p_partkey as k, [1, p_size]::bigint[] as a, [1, p_size]::bigint[] as b, [p_size, 1]::bigint[] as c from part")
case("list_index", "MATCH (p:Part) WITH p.p_partkey AS k, [p.p_size, 2, 3] AS l RETURN k, l[0] AS a, l[-1] AS b, l[7] AS c, l[null] AS d, {x: k}['x'] AS e", "select p_partkey as k, p_size::bigint as a, 3::bigint as b, null::bigint as c, null::bigint as d, p_partkey as e from part")
case("list_slice", "MATCH (p:Part) WITH p.p_partkey AS k, [p.p_size, 2, 3, 4] AS l RETURN k, l[1..3] AS a, l[..-1] AS b, l[2..] AS c, l[3..1] AS d, l[-9..9] AS e, l[null..2] AS f", "select p_partkey as k, [2, 3]::bigint[] as a, [p_size, 2, 3]::bigint[] as b, [3, 4]::bigint[] as c, []::bigint[] as d, [p_size, 2, 3, 4]::bigint[] as e, null::bigint[] as f from part")
case("property_access", "MATCH (n:Nation) WITH n, {a: n.n_name, b: {c: 1}} AS m RETURN n['n_name'] AS a, m.a AS b, m.b.c AS c, n.nothing AS d", "select n_name as a, n_name as b, 1::bigint as c, null::varchar as d from nation")
case("list_comprehension", "MATCH (p:Part) RETURN p.p_partkey AS k, [x IN range(1, 5) WHERE x % 2 = 1 | x * p.p_size] AS a, [x IN [1, null, 3] WHERE x > 1] AS b, [x IN [1, 2] | [y IN [10, 20] | x + y]] AS c", "select p_partkey as k, [p_size, 3 * p_size, 5 * p_size]::bigint[] as a, [3]::bigint[] as b, [[11, 21], [12, 22]]::bigint[][] as c from part")
case("quantifiers", "UNWIND [[1, 2], [1, null], [], [3]] AS l RETURN l, all(x IN l WHERE x < 3) AS a, any(x IN l WHERE x = 1) AS b, none(x IN l WHERE x = 1) AS c, single(x IN l WHERE x = 1) AS d", "select * from (values ([1, 2]::bigint[], true, true, false, true), ([1, null]::bigint[], null, true, false, null), ([]::bigint[], true, false, true, false), ([3]::bigint[], false, false, true, false)) t(l, a, b, c, d)")
case("reduce_fold", "MATCH (p:Part) RETURN p.p_partkey AS k, reduce(s = 0, x IN range(1, 4) | s + x * p.p_size) AS a, reduce(s = '', x IN ['a', 'b'] | s + x) AS b, reduce(s = 0, x IN [1.5] | s + x) AS c", "select p_partkey as k, (10 * p_size)::bigint as a, 'ab' as b, 1.5::double as c from part")
case("map_literal", "MATCH (n:Nation) WITH {name: n.n_name, key: n.n_nationkey} AS m RETURN m.name AS a, m.key AS b, keys(m) AS c", "select n_name as a, n_nationkey::bigint as b, ['key', 'name'] as c from nation")

# -- the asset registry
_LATEST = """c as (select id, min(committed_at) ts from log_entry group by id),
l as (select label, node_key, arg_max({o: op, p: properties, s: secondary_labels}, (ts, arrived_at)) s from node_record join c on commit_id = id group by label, node_key),
live as (select label, node_key, s.p p, s.s sl from l where s.o = 'put'),
e as (select distinct on (edge_id) * from edge_record where (src_label, src_key) in (select (label, node_key) from live) and (dst_label, dst_key) in (select (label, node_key) from live))"""
case("registry_certificate_sweep", "MATCH (h:Host)-[:HAS_CERT]->(c:Certificate) WHERE c.not_after <= 30 RETURN h.hostname AS host, c.serial AS serial, c.not_after AS day ORDER BY day, host, serial LIMIT 100", f"with {_LATEST} select e.src_key as host, e.dst_key as serial, try_cast(n.p['not_after'] as bigint) as day from e join live n on n.label = 'Certificate' and n.node_key = e.dst_key where rtype = 'HAS_CERT' and try_cast(n.p['not_after'] as bigint) <= 30 order by day, host, serial limit 100", graph="registry")
case("registry_orphaned_software", "MATCH (s:Software) WHERE NOT (:Host)-[:RUNS]->(s) RETURN s.name AS name", f"with {_LATEST} select node_key as name from live where label = 'Software' and node_key not in (select dst_key from e where rtype = 'RUNS')", graph="registry")
case("registry_hosts_by_os", "MATCH (h:Host {os: 'openfen'}) RETURN count(*) AS n", f"with {_LATEST} select count(*) as n from live where label = 'Host' and p['os'] = 'openfen'", graph="registry")
case("registry_critical_hosts", "MATCH (h:Host)-[:RUNS]->(s:Software)-[:SUPPLIED_BY]->(v:Supplier {country: 'NO'}) WHERE h.criticality >= 4 RETURN count(DISTINCT h) AS hosts", f"with {_LATEST} select count(distinct h.node_key) as hosts from live h join e r on h.label = 'Host' and r.rtype = 'RUNS' and r.src_key = h.node_key join e s on s.rtype = 'SUPPLIED_BY' and s.src_key = r.dst_key join live v on v.label = 'Supplier' and v.node_key = s.dst_key where v.p['country'] = 'NO' and try_cast(h.p['criticality'] as bigint) >= 4", graph="registry")
case("registry_blast_radius", "MATCH (v:Supplier {country: 'NO'})<-[:SUPPLIED_BY]-(s:Software) OPTIONAL MATCH (d:Software)-[:DEPENDS_ON*0..3]->(s) OPTIONAL MATCH (h:Host)-[:RUNS]->(d) RETURN count(DISTINCT h) AS hosts", f"with {_LATEST}, s0 as (select distinct src_key k from e join live v on v.label = 'Supplier' and v.node_key = dst_key where rtype = 'SUPPLIED_BY' and v.p['country'] = 'NO'), d1 as (select distinct src_key k from e where rtype = 'DEPENDS_ON' and dst_key in (select k from s0)), d2 as (select distinct src_key k from e where rtype = 'DEPENDS_ON' and dst_key in (select k from d1)), d3 as (select distinct src_key k from e where rtype = 'DEPENDS_ON' and dst_key in (select k from d2)) select count(distinct src_key) as hosts from e where rtype = 'RUNS' and dst_key in (select k from s0 union select k from d1 union select k from d2 union select k from d3)", graph="registry")
case("registry_secondary_label", "MATCH (n:Edge) RETURN labels(n)[0] AS l, count(*) AS n", f"with {_LATEST} select label as l, count(*) as n from live where list_contains(sl, 'Edge') group by label", graph="registry")
case("registry_ancestors", "MATCH (c:Commit)-[:PARENT*1..3]->(a:Commit) RETURN a.id AS id, count(*) AS n", "with p as (select distinct id a, unnest(parents) b from log_entry), p1 as (select a, b from p), p2 as (select x.a, y.b from p x join p y on x.b = y.a), p3 as (select x.a, y.b from p2 x join p y on x.b = y.a) select b as id, count(*) as n from (select * from p1 union all select * from p2 union all select * from p3) group by b", graph="registry")
case("registry_kin", "MATCH (c:Commit)-[:PARENT*1..2]-(a:Commit) RETURN a.id AS id, count(*) AS n", "with p as (select distinct id a, unnest(parents) b from log_entry), u as (select a x, b y, a || '>' || b e from p union all select b, a, a || '>' || b from p where a <> b), w as (select x, y from u union all select u.x, v.y from u join u v on u.y = v.x and u.e <> v.e) select y as id, count(*) as n from w group by y", graph="registry")


FLAGSHIP = Case(
    "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE c.c_mktsegment = 'BUILDING' AND o.o_totalprice > 1000 RETURN c.c_custkey AS custkey, count(*) AS n_orders, round(sum(o.o_totalprice) * 100) / 100 AS revenue ORDER BY revenue DESC, custkey LIMIT 20",
    "select o_custkey as custkey, count(*) as n_orders, round(sum(o_totalprice) * 100) / 100 as revenue from customer join orders on o_custkey = c_custkey where c_mktsegment = 'BUILDING' and o_totalprice > 1000 group by 1 order by revenue desc, custkey limit 20",
)
CASES["flagship"] = FLAGSHIP
QUERIES = {name: (lambda spark, sf, q=q: q.run(spark, sf)) for name, q in CASES.items()}
ORACLE = {name: q.sql for name, q in CASES.items() if q.sql}
