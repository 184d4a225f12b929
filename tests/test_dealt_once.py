"""Levels are shuffled once for rollup and layout."""

import tempfile

from pyspark.sql import functions as F

from meshlens.operators import rollups
from meshlens.sources import levels


def test_rollup_and_layout_share_a_shuffle(spark):
    i = F.col("id")
    rows = spark.range(3000).select(
        (i % 40).alias("ip_src"), F.when(i % 3 > 0, (i % 2).cast("int")).alias("vlan"), (i * 7919 % 9_000_000).alias("start"), (i * 7919 % 9_000_000 + i % 500).alias("stop"),
        i.alias("packets"), (i * 3).alias("eth_payload"), (i % 1500).cast("int").alias("mtu"),
    )
    rows, keys = rows.union(rows.limit(50)), ["ip_src", "vlan"]
    root = tempfile.mkdtemp(prefix="spark-")
    levels.write_levels(rows, root, "traffic", keys, "ip_src", buckets=7)
    names, source = [*keys, "start", "stop", "packets", "eth_payload", "mtu"], rows
    for name, step in rollups.LEVELS["traffic"].items():
        source = rollups.traffic_rollup(source, keys, step)
        found = spark.read.parquet(f"{root}/traffic/{name}")
        assert sorted(map(str, found.select(*names).collect())) == sorted(map(str, source.select(*names).collect()))
        assert found.where(F.col("ip_bucket") != F.col("ip_src") % 7).isEmpty()
    plan = levels.dealt_rollup(rows.sparkSession.read.parquet(f"{root}/traffic/1min"), keys, 60_000, "ip_src", 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange rangepartitioning" in plan
