"""Moments of values far from 0, and clipping of volumes whose product with time is beyond a long."""

from pyspark.sql import functions as F

from meshlens.functions.aggregates import merge_distributions
from meshlens.operators.top import clipped


def test_merged_moments_do_not_cancel(spark):
    one = F.struct(F.lit(1).cast("long").alias("count"), F.col("v").alias("min"), F.col("v").alias("max"), F.col("v").alias("avg"), F.lit(0.0).alias("m2"))
    rows = [(None, 1e9), (None, 1e9 + 1), (None, 1e9 + 2), (1, 5.0)]
    out = merge_distributions(spark.createDataFrame(rows, "k int, v double").select("k", one.alias("rt")), ["k"], "rt")
    got = {r.k: tuple(r.rt) for r in out.collect()}
    assert got == {None: (3, 1e9, 1e9 + 2, 1e9 + 1, 2.0), 1: (1, 5.0, 5.0, 5.0, 0.0)}


def test_clipping_of_large_volumes(spark):
    rows = [(2_000_000_000, 0, 20_000_000_000), (7, 0, 3), (2**62, 5, 5), (None, 0, 9)]
    df = spark.createDataFrame(rows, "v long, start long, stop long")
    start, stop = 1, 10_000_000_001
    want = []
    for v, s, e in rows:
        if v is not None and s < start:
            v, s = v * (e - start) // max(e - s, 1), start
        if v is not None and e > stop:
            v = v * (stop - s) // max(e - s, 1)
        want.append(v)
    assert [r.v for r in df.select(clipped(F.col("v"), start, stop).alias("v")).collect()] == want
