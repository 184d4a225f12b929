"""Joins of facts with windows of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlens.functions.times import div

#: Bins into which the time of a join is cut.
BINS = 64


def interval_join(
    rows: DataFrame, windows: DataFrame, on: dict[str, str], lo: int, hi: int, start: str = "start", stop: str = "stop", t0: str = "t0", t1: str = "t1", bins: int = BINS
) -> DataFrame:
    """Pairs of rows of the closed [start, stop] and windows of the half-open [t0, t1[ that meet, where ``on`` (row's column: window's) is equal.

    A row and a window meet if stop >= t0 and start < t1, as facts and the time of a query do; an empty window [t, t[ is
    met by rows that began before t and end at t or later. Only what lies within [lo, hi[ is looked at.

    The time is cut into ``bins`` bins; both sides go to each bin that they touch and are joined by ``on`` and bin, so a key with many
    rows or one long window is spread over the bins. A pair shares the bin of the later of both beginnings and is kept there
    alone, so nothing is doubled and nothing has to be made distinct. A row costs as many rows as it touches bins, one as
    a rule and ``bins`` at most. Rows with a null time or key meet nothing. Columns of both sides must have different names.
    """
    width = max(1, -(-(hi - lo) // bins))

    def bin_of(t: Column) -> Column:
        return div(F.greatest(F.least(t, F.lit(hi - 1)), F.lit(lo)) - lo, width).cast("int")

    a, b = F.col(start), F.col(stop)
    left = rows.where((b >= lo) & (a < hi) & (a <= b)).withColumns({"_a": bin_of(a), "_bin": F.explode(F.sequence(bin_of(a), bin_of(b)))})
    c, d = F.col(t0), F.greatest(F.col(t0), F.col(t1) - 1)
    right = windows.where((d >= lo) & (c < hi)).withColumns({"_b": bin_of(c), "_bin_": F.explode(F.sequence(bin_of(c), bin_of(d)))})
    same = (F.col("_bin") == F.col("_bin_")) & (F.col("_bin") == F.greatest("_a", "_b")) & (b >= c) & (a < F.col(t1))
    for x, y in on.items():
        same = same & (left[x] == right[y])
    return left.join(right, same).drop("_a", "_b", "_bin", "_bin_")


def merge_windows(windows: DataFrame, keys: list[str], t0: str = "t0", t1: str = "t1") -> DataFrame:
    """The same time as disjoint windows [t0, t1[ of each key; empty windows are dropped, touching ones are joined."""
    order = Window.partitionBy(*keys).orderBy(t0, t1)
    before = F.max(t1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col(t0) > before, F.lit(True)).cast("long")
    numbered = windows.where(F.col(t0) < F.col(t1)).withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(order))
    return numbered.groupBy(*keys, "_island").agg(F.min(t0).alias(t0), F.max(t1).alias(t1)).drop("_island")
