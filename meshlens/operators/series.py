"""Time series: values spread over buckets, dense buckets, series ranked by peak, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlens.functions.times import div
from meshlens.operators.top import clipped


def row_of(ms: Column, start: int, step: int) -> Column:
    return div(ms - start, step).cast("long")


def spread(df: DataFrame, keys: list[str], value: str, start: int, stop: int, step: int, rounded: bool = True) -> DataFrame:
    """(keys, row, y): ``value`` of rows [start, stop] clipped to the query and dealt evenly over its buckets.

    A row covers the buckets from that of its start up to but not with that of its stop, or its only one. However long, it makes two
    events: its share comes at its first bucket and goes after its last. Events are summed by bucket before their shuffle and again after it,
    running sums over a key's buckets give what each of them holds, and a stretch without events is written out last.
    """
    first = row_of(F.greatest("start", F.lit(start)), start, step)
    last = F.greatest(first, row_of(F.least("stop", F.lit(stop)), start, step) - 1)
    inside = df.where((F.col("stop") >= start) & (F.col("start") < stop))
    inside = inside.select(*keys, clipped(F.col(value), start, stop).alias("_y"), first.alias("_a"), last.alias("_b"))
    n = F.col("_b") - F.col("_a") + 1
    each = div(F.col("_y") + (F.floor(n / 2) if rounded else F.lit(0)), n).cast("long")
    ends = [F.struct(at.alias("row"), y.alias("y"), F.lit(k).cast("long").alias("n")) for at, y, k in ((F.col("_a"), each, 1), (F.col("_b") + 1, -each, -1))]
    events = inside.select(*keys, F.explode(F.array(*ends)).alias("_e")).groupBy(*keys, F.col("_e.row").alias("_row"))
    events = events.agg(F.sum("_e.y").cast("long").alias("_y"), F.sum("_e.n").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_row")
    held = events.select(*keys, "_row", F.lead("_row").over(order).alias("_next"), F.sum("_y").over(order).cast("long").alias("y"), F.sum("_n").over(order).alias("_n"))
    return held.where("_n > 0").select(*keys, F.explode(F.sequence("_row", F.col("_next") - 1)).alias("row"), "y")


def ranked(series: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` - 1 series with the highest peak, and the sum of the others under null with ``is_others``."""
    peak = series.groupBy(key).agg(F.max("y").alias("_p")).orderBy(F.desc("_p"), F.asc_nulls_first(key)).limit(n - 1)
    best = peak.select(F.col(key).alias("_k"), F.lit(False).alias("_o"))
    out = series.join(F.broadcast(best), series[key].eqNullSafe(best["_k"]), "left").withColumn("is_others", F.coalesce("_o", F.lit(True)))
    out = out.withColumn(key, F.when(~F.col("is_others"), F.col(key)))
    return out.groupBy(key, "is_others", "row").agg(F.sum("y").cast("long").alias("y"))


def dense(series: DataFrame, spark_rows: int, keys: list[str], fill: dict[str, object]) -> DataFrame:
    """All rows 0 to ``spark_rows`` - 1 of every key, missing ones filled."""
    rows = series.sparkSession.range(spark_rows).withColumnRenamed("id", "row")
    grid = series.select(*keys).distinct().crossJoin(F.broadcast(rows)) if keys else rows
    return grid.join(series, [*keys, "row"], "left").fillna(fill)


def per_date(df: DataFrame, value: str, start: int, stop: int, step: int) -> DataFrame:
    """Distribution of ``value`` in each bucket of [start, stop[, empty ones too: row, count, min, max, avg, std."""
    d = df.where((F.col("start") >= start) & (F.col("start") < stop)).groupBy(row_of(F.col("start"), start, step).alias("row")).agg(
        F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
    )
    return dense(d, (stop - start) // step + 1, [], {"count": 0, "min": 0.0, "max": 0.0, "avg": 0.0, "std": 0.0})


def histogram(df: DataFrame, key: str, value: str, precision: float) -> DataFrame:
    """Number of rows of each key by bucket of ``value``."""
    return df.groupBy(key, F.floor(F.col(value) / precision).alias("bucket")).agg(F.count("*").alias("n"))


def precision_of(df: DataFrame, value: str, buckets: int = 200) -> float:
    """Bucket width: a 200th of the range of all values."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    return (high - low) / buckets if high is not None and high > low else 1.0


#: Counters of a task before it hands them on.
MOST_COUNTS = 500_000


def histogram_of_unknown_range(df: DataFrame, key: str, value: str, buckets: int = 200) -> DataFrame:
    """(key, bucket, width, n): rows by bucket of ``value``, the width being the least power of two with which the range of all values has ``buckets`` at most.

    The data is read once. A task starts with the width of its first values and doubles it whenever its own range outgrows it, which
    joins buckets two by two, since all start at multiples of their width; so do the tasks' histograms, a few hundred rows a key each, once the
    greatest and least of all values are known. Null and non-finite values are left out, null keys are a key; equal values only have a width of 1.
    """
    import math

    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[key].dataType
    shape = f"key {kind.simpleString()}, e int, bucket long, n long, low double, high double"

    def handed(held, e, low, high):
        keys, at = zip(*held)
        n = list(held.values())
        columns = [pa.array(keys, to_arrow_type(kind)), pa.array([e] * len(n), pa.int32()), pa.array([None] * len(n) if e is None else at, pa.int64()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([low] * len(n)), pa.array([high] * len(n))], names=["key", "e", "bucket", "n", "low", "high"])

    def run(batches):
        held, e, low, high = {}, None, math.inf, -math.inf
        for batch in batches:
            x = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            fine = np.isfinite(x)
            if not fine.any():
                continue
            x, names = x[fine], batch.column(0).filter(pa.array(fine)).dictionary_encode(null_encoding="encode")
            low, high = min(low, x.min()), max(high, x.max())
            now = power(high - low, buckets)
            if now is not None and (e is None or now > e):
                if e is not None:
                    joined = {}
                    for (k, b), n in held.items():
                        at = (k, b >> (now - e))
                        joined[at] = joined.get(at, 0) + n
                    held = joined
                elif held:  # equal values so far
                    held = {(k, math.floor(low_ / 2.0**now)): n for (k, low_), n in held.items()}
                e = now
            at = np.floor(x / 2.0**e).astype(np.int64) if e is not None else x
            codes = np.asarray(names.indices)
            words = names.dictionary.to_pylist()
            pairs, counts = np.unique(np.rec.fromarrays([codes, at]), return_counts=True)
            for (c, b), n in zip(pairs.tolist(), counts.tolist()):
                held[words[c], b] = held.get((words[c], b), 0) + n
            if len(held) > MOST_COUNTS:  # many keys
                yield handed(held, e, low, high)
                held = {}
        if held:
            yield handed(held, e, low, high)

    parts = df.select(key, F.col(value).cast("double")).mapInArrow(run, shape)
    parts = parts.groupBy("key", "e", "bucket", F.when(F.col("bucket").isNull(), F.col("low")).alias("_one")).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    spread_ = F.col("_high") - F.col("_low")
    wide = parts.withColumns({"_low": F.min("low").over(Window.partitionBy()), "_high": F.max("high").over(Window.partitionBy())})
    width = F.when(spread_ > 0, F.pow(F.lit(2.0), F.ceil(F.log2(spread_ / buckets)))).otherwise(1.0)
    shift = (F.log2("_w") - F.col("e")).cast("int")
    at = F.when(F.col("bucket").isNull(), F.floor(F.col("_one") / F.col("_w"))).otherwise(F.call_function("shiftright", F.col("bucket"), shift))
    out = wide.withColumn("_w", width).select(F.col("key").alias(key), at.alias("bucket"), F.col("_w").alias("width"), "n")
    return out.groupBy(key, "bucket", "width").agg(F.sum("n").alias("n"))


def power(span: float, buckets: int) -> int | None:
    """Exponent of the least power of two that cuts ``span`` into ``buckets`` at most; null for no span."""
    import math

    return math.ceil(math.log2(span / buckets)) if span > 0 else None


def rates(series: DataFrame, step: int) -> DataFrame:
    return series.withColumn("rate", F.col("y") / (step / 1000))


def by_label(series: DataFrame, label: str) -> DataFrame:
    return series.groupBy(label).agg(F.sum("y").cast("long").alias("total"), F.avg("y").alias("average"), F.max("y").alias("peak"))


def positions(series: DataFrame, label: str) -> DataFrame:
    """Rank of each series by peak."""
    peaks = by_label(series, label)
    return peaks.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("peak"), F.asc_nulls_first(label))))
