"""Aggregates: whole-number ones and mergeable distributions (count, min, max, avg, m2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def max_int(x: Column) -> Column:
    return F.coalesce(F.max(x), F.lit(0))


def min_int(x: Column) -> Column:
    return F.coalesce(F.min(x), F.lit(0))


def sum_int(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0)).cast("long")


def avg_int(x: Column) -> Column:
    """Truncated average of whole numbers."""
    return F.coalesce(F.try_divide(F.sum(x) - F.sum(x) % F.count(x), F.count(x)), F.lit(0)).cast("long")


INT_AGGREGATES = {"max": max_int, "min": min_int, "sum": sum_int, "avg": avg_int}


def distribution(x: Column) -> Column:
    """struct(count, min, max, avg, m2) of the values of a group, m2 being the sum of squared deviations."""
    m2 = F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0))
    return F.struct(F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("avg"), m2.alias("m2"))


#: Parts into which the rows of a group are dealt before they are merged.
SALTS = 8


def merge_distributions(parts: DataFrame, keys: list[str], column: str, salts: int = SALTS, sums: tuple[str, ...] = ()) -> DataFrame:
    """Merge by the average A of each group: m2 = sum(m2_i + n_i (avg_i - A)^2), which does not cancel.

    One shuffle serves the averages and the sums of a group. Groups are first merged within ``salts`` parts, so that a hot one is no
    single task; the second merge gets that many rows a group at most. The input is read once. ``sums`` are summed besides.
    """
    d, salt = F.col(column), "_salt"
    own = parts.select(*keys, d, *sums, F.pmod(F.xxhash64(d) + F.spark_partition_id(), F.lit(salts)).alias(salt))
    return _merged(_merged(own, [*keys, salt], column, sums), keys, column, sums)


def _merged(parts: DataFrame, keys: list[str], column: str, sums: tuple[str, ...]) -> DataFrame:
    d, group = F.col(column), Window.partitionBy(*keys)
    average = F.sum(d["count"] * d["avg"]).over(group) / F.sum(d["count"]).over(group)
    apart = d["avg"] - F.col("_avg")
    whole = parts.withColumn("_avg", average).groupBy(*keys).agg(
        F.sum(d["count"]).alias("count"), F.min(d["min"]).alias("min"), F.max(d["max"]).alias("max"), F.min("_avg").alias("avg"),
        F.sum(d["m2"] + d["count"] * apart * apart).alias("m2"), *[F.sum(c).cast("long").alias(f"_sum{i}") for i, c in enumerate(sums)],
    )
    return whole.select(*keys, F.struct("count", "min", "max", "avg", "m2").alias(column), *[F.col(f"_sum{i}").alias(c) for i, c in enumerate(sums)])


def std_dev(count: Column, m2: Column) -> Column:
    """Sample deviation, 0 for one value or none."""
    return F.when(count > 1, F.sqrt(m2 / (count - 1))).otherwise(0.0)
