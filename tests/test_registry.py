from datetime import datetime, timedelta

from compare import DATA, duck

from graphloam.plans.graph_queries import QUERIES

T0 = datetime(2024, 1, 1)
LOG = "id string, message string, parents array<string>, committed_at timestamp"
NODES = "commit_id string, label string, node_key string, op string, secondary_labels array<string>, properties map<string,string>, arrived_at timestamp"
EDGES = "edge_id bigint, rtype string, src_label string, src_key string, dst_label string, dst_key string, discriminator string, properties map<string,string>"


def exposed(spark, data):
    return QUERIES["registry_blast_radius"](spark, str(data)).collect()[0]["hosts"]


def test_blast_radius_ends_after_the_third_dependency(spark, tmp_path):
    """Software s0 of the supplier, s1 to s5 each needing the one before, host hI running sI alone."""
    nodes = [("Supplier", "v", {"country": "NO"}), *[(label, f"{label[0].lower()}{i}", {}) for label in ("Software", "Host") for i in range(6)]]
    ends = [("SUPPLIED_BY", "Software", "s0", "Supplier", "v")]
    ends += [("DEPENDS_ON", "Software", f"s{i + 1}", "Software", f"s{i}") for i in range(5)]
    ends += [("RUNS", "Host", f"h{i}", "Software", f"s{i}") for i in range(6)]
    made = {
        "log_entry": ([("c0", None, [], T0)], LOG),
        "node_record": ([("c0", label, k, "put", None, p, T0 + timedelta(hours=1)) for label, k, p in nodes], NODES),
        "edge_record": ([(i, *e, None, {}) for i, e in enumerate(ends)], EDGES),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert exposed(spark, tmp_path) == 4


def test_blast_radius_against_a_walk_over_sets(spark):
    con = duck(DATA)
    at = dict(con.execute("select id, min(committed_at) from log_entry group by id").fetchall())
    latest = {}
    for c, arrived, label, k, op, country in con.execute("select commit_id, arrived_at, label, node_key, op, properties['country'] from node_record").fetchall():
        if c in at:
            latest[label, k] = max(latest.get((label, k), ()), (at[c], arrived, op, country or ""))
    live = {n: s[3] for n, s in latest.items() if s[2] == "put"}
    edges = {(r, (a, x), (b, y)) for r, a, x, b, y in con.execute("select rtype, src_label, src_key, dst_label, dst_key from edge_record").fetchall() if (a, x) in live and (b, y) in live}
    newest = {a for r, a, b in edges if r == "SUPPLIED_BY" and b[0] == "Supplier" and live[b] == "NO"}
    reached, hosts = set(newest), []
    for _ in range(4):
        hosts.append(len({a for r, a, b in edges if r == "RUNS" and b in reached}))
        newest = {a for r, a, b in edges if r == "DEPENDS_ON" and b in newest}
        reached |= newest
    assert hosts[2] < hosts[3] == exposed(spark, DATA)
