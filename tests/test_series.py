"""Spreading by events, two-pass significant keys and histograms of unknown range against plain loops."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from meshlens.operators import series, top


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def dealt(facts, start, stop, step, rounded):
    out = Counter()
    for k, a, b, y in facts:
        if b < start or a >= stop:
            continue
        v, s = (y * (b - start) // max(b - a, 1), start) if a < start else (y, a)
        v = v * (stop - s) // max(b - s, 1) if b > stop else v
        first = (max(a, start) - start) // step
        last = max(first, (min(b, stop) - start) // step - 1)
        n = last - first + 1
        for row in range(first, last + 1):
            out[k, row] += (v + (n // 2 if rounded else 0)) // n
    return sorted(((k, row, y) for (k, row), y in out.items()), key=str)


def test_spread_equals_dealing_by_hand(spark):
    rng = random.Random(21)
    facts = [(rng.choice(["a", "b", None]), a := rng.randrange(-300, 1300), a + rng.choice([0, 0, 3, 90, 1000]), rng.choice([0, rng.randrange(10**6)])) for _ in range(300)]
    df = spark.createDataFrame(facts, "k string, start long, stop long, y long")
    for rounded in (True, False):
        assert rows(series.spread(df, ["k"], "y", 0, 1000, 37, rounded)) == dealt(facts, 0, 1000, 37, rounded)
    assert series.spread(df.limit(0), ["k"], "y", 0, 1000, 37).count() == 0


def test_long_rows_make_two_events(spark):
    df = spark.range(0, 400, 1, 4).select((F.col("id") % 200).alias("k"), F.lit(0).cast("long").alias("start"), F.lit(10**6).alias("stop"), (F.col("id") + 10**6).alias("y"))
    out = series.spread(df, ["k"], "y", 0, 10**6, 1000)
    assert out.count() == 200 * 1000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(sequence") < plan.index("Window") < plan.index("Exchange") < plan.index("explode(array")


def test_two_passes_find_the_same_keys_as_one(spark):
    rng = random.Random(3)
    for n, heavy in ((10, 4), (50, 30)):
        found = [(rng.randrange(3000), rng.choice([1, 2, None]), rng.randrange(5)) for _ in range(4000)] + [(k % heavy, None if k % 2 else 1, rng.randrange(200)) for k in range(600)]
        df = spark.createDataFrame(found, "a int, b int, v long").repartition(5)
        assert rows(top.significant_two_pass(df, ["a", "b"], "v", n)) == rows(top.significant(df, ["a", "b"], "v", n))
    assert top.significant_two_pass(df.limit(0), ["a", "b"], "v", 9).count() == 0


def test_only_candidates_are_summed_by_key(spark):
    df = spark.range(0, 20_000, 1, 4).select("id", (F.col("id") % 7).alias("b"), F.lit(1).cast("long").alias("v"))
    assert rows(top.significant_two_pass(df, ["id", "b"], "v", 20)) == [(None, None, True, 20_000)]
    heavy = top.heavy_hitters(df, "id", "v", 20, slots=40)
    assert heavy.count() <= 80


def histogram(values, buckets):
    fine = [v for _, v in values if v is not None and math.isfinite(v)]
    span = max(fine) - min(fine)
    width = 2.0 ** math.ceil(math.log2(span / buckets)) if span > 0 else 1.0
    out = Counter((k, math.floor(v / width), width) for k, v in values if v is not None and math.isfinite(v))
    return sorted(((*k, n) for k, n in out.items()), key=str)


def test_histogram_of_unknown_range(spark, monkeypatch):
    rng = random.Random(11)
    grows = [(rng.choice(["x", "y", None]), rng.gauss(0, 1) * 3**i) for i in range(12) for _ in range(60)]
    odd = [("x", None), ("y", float("nan")), ("y", float("inf")), ("z", -7.25)]
    for values in (grows, grows + odd, [("x", 2.5)] * 9, [("x", 2.5)] * 9 + [("y", 2.75), ("x", -3.0)], [("n", -1e-9), ("n", 1e-9)]):
        df = spark.createDataFrame(values, "k string, v double").coalesce(1).repartition(3)
        for buckets in (200, 7):
            assert rows(series.histogram_of_unknown_range(df, "k", "v", buckets)) == histogram(values, buckets)
    monkeypatch.setattr(series, "MOST_COUNTS", 5)
    assert rows(series.histogram_of_unknown_range(df, "k", "v", 7)) == histogram(values, 7)
    assert series.histogram_of_unknown_range(df.limit(0), "k", "v").count() == 0
