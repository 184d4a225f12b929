import tempfile

import pytest
from pyspark.sql import functions as F

from meshlens.operators import graphs, presets, rollups, series, top
from meshlens.sources import facts
from meshlens.streaming import ingest


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_clip_and_spread(spark):
    df = spark.createDataFrame([("a", 0, 100, 100), ("a", 50, 50, 7), ("b", -100, 100, 200)], "k string, start long, stop long, y long")
    out = rows(series.spread(df, ["k"], "y", 0, 100, 25))
    assert sum(y for k, _, y in out if k == "a") == 107 and sum(y for k, _, y in out if k == "b") == 100
    assert ("a", 2, 32) in out


def test_top_has_others_and_total(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), (None, 9), ("c", 1)], "k string, v long")
    out = {(r.k, r.kind): (r.sort_value, r.n) for r in top.top(df, ["k"], {"n": ("max", "v")}, "v", 2).collect()}
    assert out == {("a", "key"): (5, 5), (None, "key"): (9, 9), (None, "others"): (4, 3), (None, "total"): (18, 9)}


def test_heavy_hitters_bounds(spark):
    df = spark.range(3000).select((F.col("id") % 10).alias("k"), F.when(F.col("id") % 10 == 3, 100).otherwise(1).cast("long").alias("v"))
    out = {r.key: (r.low, r.high) for r in top.heavy_hitters(df, "k", "v", 4, slots=4).collect()}
    assert 3 in out and out[3][0] <= 30000 <= out[3][1]


def test_signed_graph(spark):
    df = spark.createDataFrame([("a", "b", 5), ("b", "a", 7), ("a", "c", 1)], "s string, d string, v long").withColumns({"start": F.lit(0), "stop": F.lit(1)})
    assert rows(graphs.network_graph(df, "s", "d", "v")) == [("a", "b", -2), ("a", "c", 1)]
    assert rows(graphs.network_graph(df, "s", "d", "v", min_volume=2)) == []
    assert rows(graphs.network_graph(df, "s", "d", "v", min_volume=2, signed=False)) == [("a", "b", -2)]


def test_callflow_with_cycle(spark):
    flows = [(1, 2, 10, 20, 1), (2, 3, 12, 30, 1), (3, 1, 25, 26, 1), (2, 4, 1, 5, 1), (4, 5, 40, 41, 1), (3, 4, 28, 29, 1)]
    df = spark.createDataFrame(flows, "ip_src long, ip_dst long, start long, stop long, y long")
    got = {(r.hop, r.ip_src, r.ip_dst) for r in graphs.callflow(df, 1, 0, 100).collect()}
    assert got == {(1, 1, 2), (2, 2, 3), (3, 3, 1), (3, 3, 4)}


def test_rollup_of_rollup_is_rollup(spark):
    df = spark.createDataFrame([(i % 3, i * 1000, i * 1000 + 1, i, i, 1500 + i) for i in range(50)], "k int, start long, stop long, packets long, eth_payload long, mtu int")
    twice = rollups.traffic_rollup(rollups.traffic_rollup(df, ["k"], 5000), ["k"], 20_000)
    assert rows(twice) == rows(rollups.traffic_rollup(df, ["k"], 20_000))
    assert rollups.level_for("dns", 7_200_000) == "1hour" and rollups.level_for("traffic", 1) == "1min"


def test_text_rows(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/t.tsv"
    line = "iface eth0\t1323766040s 992799us\t1323766042s 539807us\t274\tSome 250\tb4:a4:e3:4d:5c:01\t88:43:e1:1d:6d:01\t2048\t309884\t1409\t193.48.95.81\t134.206.1.47\t17\t304404\t54694\t49164\t302212\n"
    with open(path, "w") as f:
        f.write(line + line.replace("Some 250", "None"))
    a, b = facts.load_text(spark, "traffic", path).collect()
    assert (a.start, a.stop, a.vlan, a.eth_payload, a.origin.name, b.vlan) == (1323766040993, 1323766042540, 250, 309884, "eth0", None)


def test_bucketed_table_prunes(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/t"
    df = spark.range(200).select((F.col("id") + (10 << 24)).alias("ip_src"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 5).alias("stop"))
    facts.write_table(df, path, "ip_src", buckets=16)
    out = facts.read_table(spark, path, start=0, stop=500, cidr=((10 << 24) + 8, 30), buckets=16)
    assert sorted(r.ip_src - (10 << 24) for r in out.collect()) == [8, 9, 10, 11]
    assert "PartitionFilters: [ip_bucket" in out._jdf.queryExecution().toString()


def test_presets(spark):
    df = spark.createDataFrame([(1, 5, None, 80, 1), (5, 9, 3, 1, 80)], "start long, stop long, vlan int, port_src int, port_dst int")
    assert presets.traffic(df, port=80).count() == 2
    assert presets.traffic(df, vlan=3).count() == 1 and presets.traffic(df, no_vlan=True).count() == 1
    assert presets.traffic(df, start=5, stop=6).count() == 2 and presets.traffic(df, start=0, stop=5).count() == 1


def test_stream_rollup_equals_batch(spark):
    source, out = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    df = spark.range(100).select(F.timestamp_seconds(F.col("id") * 7).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").alias("v"), F.col("id").alias("m"))
    df.write.mode("append").parquet(source)
    spark.range(1).select(F.timestamp_seconds(F.lit(10**6)).alias("ts"), F.lit(9).cast("long").alias("k"), F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("m")).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    query = ingest.rollup(stream, "ts", ["k"], "1 minute", "1 minute", ["v"], ["m"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    want = df.groupBy(F.window("ts", "1 minute"), "k").agg(F.sum("v"), F.max("m")).select("window.start", "k", "sum(v)", "max(m)")
    assert rows(spark.read.parquet(out).select("start", "k", "v", "m")) == rows(want)


def test_match_of_queries_and_answers(spark):
    q = spark.createDataFrame([(1, 0), (2, 5)], "k int, s int").select("k", F.timestamp_seconds("s").alias("ts"))
    a = spark.createDataFrame([(1, 3), (2, 100)], "k int, s int").select("k", F.timestamp_seconds("s").alias("ts"))
    assert {(r.k, r.rt, r.timed_out) for r in ingest.match(q, a, ["k"], "60 seconds", "1 minute", True).collect()} == {(1, 3.0, False), (2, 0.0, True)}


@pytest.mark.parametrize("name", ["top_others_total", "per_time_app", "network_graph_signed", "distribution_merge", "session_gap"])
def test_queries_against_duckdb(spark, name):
    import duckdb

    from meshlens.plans import catalog_queries

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = catalog_queries.queries()[name](spark, d)
    want = con.sql(catalog_queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert rows(got.select(*columns)) == sorted(want.select(*columns).fetchall(), key=str)
