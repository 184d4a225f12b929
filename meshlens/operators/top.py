"""Top-N by keys with others and total, significant keys, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlens.functions.times import div
from meshlens.sources.staging import staged


def portion(value: Column, a: Column, b: Column, lo: Column | None, hi: Column | None) -> Column:
    """The share of ``value`` of the closed [a, b] that falls into [lo, hi[ (null: no such end), cut to a whole number once for each end.

    Products of a volume and milliseconds that are beyond a long go through decimals.
    """

    def part(v: Column, inside: Column, whole: Column) -> Column:
        width = F.greatest(whole, F.lit(1))
        wide = div(v.cast("decimal(19,0)") * inside.cast("decimal(18,0)"), width.cast("decimal(18,0)"))
        return F.when(F.abs(v.cast("double")) * inside.cast("double") < 9e18, div(v * inside, width)).otherwise(wide)

    first, s = value, a
    if lo is not None:
        first, s = F.when(a < lo, part(value, b - lo, b - a)).otherwise(value), F.greatest(a, lo)
    return first if hi is None else F.when(b > hi, part(first, hi - s, b - s)).otherwise(first)


def clipped(value: Column, start: int | None, stop: int | None) -> Column:
    """The share of ``value`` of a row [start, stop] that falls into the query's time, in whole numbers."""
    return portion(value.cast("long"), F.col("start"), F.col("stop"), *[None if t is None else F.lit(t).cast("long") for t in (start, stop)])


#: What is kept of a field for each key, and how the aggregates of several keys come of it.
_PARTS = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}
_MERGED = {
    "max": lambda f: F.coalesce(F.max(f"_max_{f}"), F.lit(0)),
    "min": lambda f: F.coalesce(F.min(f"_min_{f}"), F.lit(0)),
    "sum": lambda f: F.coalesce(F.sum(f"_sum_{f}"), F.lit(0)).cast("long"),
    "avg": lambda f: F.coalesce(F.try_divide(F.sum(f"_sum_{f}") - F.sum(f"_sum_{f}") % F.sum(f"_count_{f}"), F.sum(f"_count_{f}")), F.lit(0)).cast("long"),
}


def top(
    df: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str]], sort: str, n: int = 20, start: int | None = None, stop: int | None = None,
    ranked: bool = False,
) -> DataFrame:
    """The ``n`` keys with the largest sum of ``sort``, a row of the others and one of the total; with ``ranked`` in this order, ``rank`` from 1.

    ``aggregates`` maps names to (aggregate, field), aggregates being max, min, sum and avg over whole numbers.
    The sort value alone is clipped to the query's time. Adds sort_value and kind ('key', 'others', 'total'); ties are broken by key. ``df`` is read once: it is
    grouped by key with sums, counts and extremes, which are combined before the shuffle and staged, and ranking, others and total are made of these
    rows of keys: a top-n by rank limit, joined back by broadcast of n rows.
    """
    parts = {"_v": F.sum(clipped(F.col(sort), start, stop)).cast("long")}  # of each key, from which all rows of the result are made
    for field in sorted({f for _, f in aggregates.values()}):
        used = {a for a, f in aggregates.values() if f == field}
        parts |= {f"_{a}_{field}": part(F.col(field)) for a, part in _PARTS.items() if a in used or (a in ("sum", "count") and "avg" in used)}
    sums = staged(df.groupBy(*keys).agg(*[x.alias(name) for name, x in parts.items()]), "sums")
    best = sums.orderBy(F.desc("_v"), *[F.asc_nulls_first(k) for k in keys]).limit(n)
    best = best.select(*keys, F.lit(True).alias("_best"))
    same = [sums[k].eqNullSafe(best[k]) for k in keys]
    marked = sums.join(F.broadcast(best), same, "left").select(sums["*"], F.coalesce("_best", F.lit(False)).alias("_best"))
    kept = [F.when(F.col("_best"), F.col(k)).alias(k) for k in keys]
    aggs = [F.sum("_v").cast("long").alias("sort_value"), *[_MERGED[a](f).alias(name) for name, (a, f) in aggregates.items()]]
    groups = marked.select(*kept, "_best", *parts).groupBy("_best", *keys).agg(*aggs)
    groups = groups.withColumn("kind", F.when(F.col("_best"), "key").otherwise("others")).drop("_best")
    total = sums.agg(*aggs).select(*[F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys], "*", F.lit("total").alias("kind"))
    out = groups.unionByName(total)
    if not ranked:
        return out
    place = F.when(F.col("kind") == "key", 0).when(F.col("kind") == "others", 1).otherwise(2)
    order = [place, F.desc("sort_value"), *[F.asc_nulls_first(k) for k in keys]]
    return out.withColumn("rank", F.row_number().over(Window.orderBy(*order))).orderBy("rank")  # n + 2 rows


def significant(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """Sums of the keys that have more than an nth of the total (cut to a whole number), and of the rest under null keys.

    Adds ``is_rest``. The total is one row, joined by broadcast.
    """
    sums = df.groupBy(*keys).agg(F.sum(value).cast("long").alias("v"))
    total = sums.agg(F.sum("v").alias("t"))
    marked = sums.crossJoin(F.broadcast(total)).withColumn("is_rest", F.col("v") < div(F.col("t").cast("long"), n).cast("long"))
    kept = [F.when(~F.col("is_rest"), F.col(k)).alias(k) for k in keys]
    return marked.select(*kept, "is_rest", "v").groupBy(*keys, "is_rest").agg(F.sum("v").cast("long").alias("v"))


def significant_two_pass(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """The same as ``significant`` for values of 0 or more, without a sum for each key that occurs.

    The first pass sketches the heavy keys: every key above an nth of the total is among at most 4 n candidates, since the sketch's error is a 2nth of the
    total or less. They are broadcast to a second pass, which sums them exactly and everything else as one group; only these
    are shuffled. Pays off where distinct keys are many, as pairs of addresses are.
    """
    name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = df.select(*keys, F.col(value).alias("_v"), name.alias("_key"))
    found = heavy_hitters(rows, "_key", "_v", n, slots=2 * n).select(F.col("key").alias("_heavy"))
    marked = rows.join(F.broadcast(found), F.col("_key") == F.col("_heavy"), "left")
    heavy = F.col("_heavy").isNotNull()
    sums = marked.groupBy(*[F.when(heavy, F.col(k)).alias(k) for k in keys], heavy.alias("_known")).agg(F.sum("_v").cast("long").alias("v"))
    total = F.sum("v").over(Window.partitionBy())  # 4 n rows and one
    ranked = sums.withColumn("is_rest", ~F.col("_known") | (F.col("v") < div(total, n).cast("long")))
    kept = [F.when(~F.col("is_rest"), F.col(k)).alias(k) for k in keys]
    return ranked.select(*kept, "is_rest", "v").groupBy(*keys, "is_rest").agg(F.sum("v").cast("long").alias("v"))


def top_rows(df: DataFrame, by: str, n: int, largest: bool, *ties: str) -> DataFrame:
    """The ``n`` rows with the largest or smallest ``by``."""
    return df.orderBy(F.desc(by) if largest else F.asc(by), *ties).limit(n)


def share(df: DataFrame, value: str, total: str = "total", share_: str = "share") -> DataFrame:
    """Each row's value against the sum of all; the sum is one row, joined by broadcast."""
    return df.crossJoin(F.broadcast(df.agg(F.sum(value).alias(total)))).withColumn(share_, F.col(value) / F.col(total))


def weights(df: DataFrame, value: str) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(F.max(value).alias("_m")))).withColumn("weight", F.col(value) / F.col("_m")).drop("_m")


def stacked(series: DataFrame, label: str, row: str, y: str) -> DataFrame:
    """Running sum over labels in each time step, as stacked charts draw it."""
    w = Window.partitionBy(row).orderBy(label).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("stacked", F.sum(y).over(w).cast("long"))


def heavy_hitters(df: DataFrame, key: str, value: str, n: int, slots: int = 1000) -> DataFrame:
    """Approximate sums of the heavy keys with error bounds: key, low, high; every key above total / slots is there.

    Each task keeps ``slots`` counters (weighted Misra-Gries); counters are merged by sums, and the sum of what
    tasks took away bounds the error. Rows of the result are those with high >= total / n.
    """
    import pandas as pd

    kind = df.schema[key].dataType.simpleString()

    def sketch(batches):
        held: dict = {}
        taken = total = 0
        for b in batches:
            sums = b.groupby(key, dropna=False)[value].sum()
            total += int(sums.sum())
            for k, v in sums.items():
                held[k] = held.get(k, 0) + int(v)
            if len(held) > slots:
                cut = sorted(held.values(), reverse=True)[slots]
                taken += cut
                held = {k: v - cut for k, v in held.items() if v > cut}
        rows = [(k, v, 0, 0) for k, v in held.items()] + [(None, 0, taken, total)]
        yield pd.DataFrame(rows, columns=["key", "low", "taken", "total"]).astype({"low": "int64", "taken": "int64", "total": "int64"})

    parts = df.where(F.col(key).isNotNull()).select(key, value).mapInPandas(sketch, f"key {kind}, low long, taken long, total long")
    sums = parts.groupBy("key").agg(F.sum("low").alias("low"), F.sum("taken").alias("taken"), F.sum("total").alias("total"))
    error = sums.where("key IS NULL").select(F.col("taken").alias("_error"), F.col("total").alias("_total"))
    out = sums.where("key IS NOT NULL").crossJoin(F.broadcast(error)).withColumn("high", F.col("low") + F.col("_error"))
    return out.where(F.col("high") * n >= F.col("_total")).select("key", "low", "high")
