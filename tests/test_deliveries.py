from datetime import datetime, timedelta

from graphloam.plans.problems import _deliveries

T0 = datetime(2024, 1, 1)
END = "struct<label:string,key:array<string>>"
IMPORTS = f"rec_id bigint, kind string, rtype string, src {END}, dst {END}, discriminator string, recorded_at timestamp, period string"
EDGES = "edge_id bigint, rtype string, src_label string, src_key string, dst_label string, dst_key string, discriminator string, recorded_at timestamp, period string"


def test_every_earlier_import_row_of_the_discriminator_is_a_parent(spark, tmp_path):
    h = lambda i: T0 + timedelta(hours=i)
    a, b = ("Host", ["a"]), ("Software", ["b"])
    rows = [(1, "x", 1), (2, "x", 2), (2, "x", 2), (3, "x", 9), (4, "y", 1), (5, None, 1), (6, "", 1)]
    imports = [(i, "edge", "RUNS", a, b, d, h(t), "p") for i, d, t in rows] + [(7, "node", None, None, None, None, h(0), "p")]
    edges = [(i, "RUNS", "Host", "a", "Software", "b", d, h(t), "p") for i, d, t in [(10, "x", 5), (11, "y", 5), (12, None, 5), (13, "z", 5), (14, "", 5), (15, "x", 1)]]
    spark.createDataFrame(imports, IMPORTS).write.parquet(f"{tmp_path}/import_record.parquet")
    spark.createDataFrame(edges, EDGES).write.parquet(f"{tmp_path}/edge_record.parquet")
    links = _deliveries(spark, str(tmp_path))[1]
    assert sorted({(r["child_id"], r["parent_id"]) for r in links.collect()}) == [(10, 1), (10, 2), (11, 4), (12, 5), (14, 6), (15, 1)]
