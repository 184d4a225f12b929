"""Levels of detail: ranges covered without gap or overlap, the sums of raw rows, and scans that skip what they don't need."""

import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from meshlens.functions.aggregates import merge_distributions
from meshlens.operators import rollups
from meshlens.sources import facts, levels

HOUR = 3_600_000


def test_cover_has_each_moment_once():
    rng = random.Random(3)
    steps = {"raw": 0, "1min": 60, "10mins": 600, "1hour": 3600}
    for _ in range(500):
        a = rng.randrange(20_000)
        b = a + rng.choice([0, 1, 59, 700, 4000, 9000])
        found = levels.cover(a, b, steps)
        assert [x for _, lo, hi in found for x in range(lo, hi)] == list(range(a, b))
        assert all(not steps[n] or lo % steps[n] == hi % steps[n] == 0 for n, lo, hi in found)
        assert all(b - a < 2 * 3600 or sum(hi - lo for n, lo, hi in found if n != "1hour") <= 2 * 3600 for _ in (0,))
    assert levels.cover(30, 90, {"1min": 60}) == [("1min", 0, 120)] and levels.cover(9, 9, steps) == []
    assert set(levels.fitting("traffic", 30 * 60_000)) == {"1min", "10mins"} and set(levels.fitting("traffic", 1)) == {"1min"}


@pytest.fixture(scope="module")
def stored(spark):
    rng = random.Random(5)
    rows = [((10 << 24) + rng.choice([7, 7, 7, *range(40)]), rng.choice(["a", "b"]), rng.randrange(9 * HOUR), rng.random()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "ip_srv long, name string, start long, v double")
    v = F.col("v")
    df = df.withColumn("rt", F.struct(F.lit(1).cast("long").alias("count"), v.alias("min"), v.alias("max"), v.alias("avg"), F.lit(0.0).alias("m2"))).drop("v")
    root = tempfile.mkdtemp(prefix="spark-")
    levels.write_levels(df, root, "dns", ["ip_srv", "name"], "ip_srv", buckets=16)
    return df, root


def flat(df):
    return sorted((r.name, r.rt[0], round(r.rt[1], 9), round(r.rt[2], 9), round(r.rt[3], 9), round(r.rt[4], 6)) for r in df.collect())


def test_sums_are_those_of_raw_rows(spark, stored):
    df, root = stored
    for a, b, cidr in ((1234, 8 * HOUR - 77, None), (HOUR, 3 * HOUR, None), (HOUR + 5, HOUR + 50_000, None), (-5, 20 * HOUR, ((10 << 24) + 4, 30)), (7, 7, None)):
        got = levels.read_levels(spark, root, "dns", a, b, ["name", "rt"], cidr=cidr, ip="ip_srv", buckets=16)
        raw = df.where((F.col("start") >= a) & (F.col("start") < b))
        raw = raw if cidr is None else raw.where(F.col("ip_srv").between(cidr[0], cidr[0] + 3))
        assert flat(merge_distributions(got, ["name"], "rt")) == flat(merge_distributions(raw, ["name"], "rt"))
    whole = levels.read_levels(spark, root, "dns", 1234, 8 * HOUR - 77, ["rt"], ip="ip_srv", buckets=16)
    assert {r.level for r in whole.collect()} == {"queries", "1min", "1hour"} and whole.count() < df.count()


def test_scans_skip_buckets_and_times(spark, stored):
    _, root = stored
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    got = levels.read_levels(spark, root, "dns", 1234, 8 * HOUR - 77, ["rt"], cidr=((10 << 24) + 4, 30), ip="ip_srv", buckets=16)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet.*", plan)
    assert len(scans) == 5
    for scan in scans:
        assert "PartitionFilters: [ip_bucket" in scan and re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(start,\d+\), LessThan\(start,\d+\)", scan)
        assert "name" not in scan.split("ReadSchema")[1]
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_hot_bucket_is_many_files(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/t"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # else so few rows are one file
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(7).alias("ip_src"), F.col("id").alias("start"), F.col("id").alias("stop"))
    facts.write_table(df, path, "ip_src", buckets=16)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = spark.read.parquet(path).where("ip_bucket = 7").groupBy(F.input_file_name()).agg(F.min("start").alias("a"), F.max("start").alias("b")).orderBy("a").collect()
    assert len(hot) > 1 and all(x.b < y.a for x, y in zip(hot, hot[1:]))
    out = tempfile.mkdtemp(prefix="spark-") + "/c"
    facts.compact(spark, path, out, 3)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, spark.read.parquet(path).collect()))


def test_distributions_are_merged_in_one_read(spark, stored):
    _, root = stored
    rows = spark.read.parquet(f"{root}/dns/queries")
    plan = merge_distributions(rows, ["name"], "rt")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2
    twice = rollups.transaction_rollup(rollups.transaction_rollup(rows, ["ip_srv", "name"], 60_000), ["ip_srv", "name"], HOUR)
    assert twice._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
