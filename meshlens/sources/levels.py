"""Tables of several levels of detail: written in a chain, read by the coarsest that fit, with edges filled from finer ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.functions import net, times
from meshlens.operators import rollups
from meshlens.sources import facts


def cover(start: int, stop: int, steps: dict[str, int]) -> list[tuple[str, int, int]]:
    """Disjoint ranges (level, from, to) that make up [start, stop[, each of whole steps of its level.

    The coarsest level takes all its whole steps inside, the next finer one what is left at both edges, and so on; ``steps`` maps levels to
    milliseconds, 0 for rows as they are. Without such rows the finest level takes the edges, rounded outwards.
    """
    if start >= stop:
        return []
    name, step = max(steps.items(), key=lambda x: x[1])
    finer = {k: v for k, v in steps.items() if k != name}
    if not step:
        return [(name, start, stop)]
    if not finer:
        return [(name, start // step * step, -(-stop // step) * step)]
    low, high = -(-start // step) * step, stop // step * step
    if low >= high:
        return cover(start, stop, finer)
    return [*cover(start, low, finer), (name, low, high), *cover(high, stop, finer)]


def fitting(metric: str, wanted: int | None) -> dict[str, int]:
    """The levels of ``metric`` that a series with steps of ``wanted`` ms may be made of: those that round to a divisor of it; all without one."""
    levels = {name: step for name, step in rollups.LEVELS[metric].items() if wanted is None or not step or wanted % step == 0}
    return levels or dict([min(rollups.LEVELS[metric].items(), key=lambda x: x[1])])


def dealt_rollup(rows: DataFrame, keys: list[str], step: int, ip: str, buckets: int) -> DataFrame:
    """Traffic rolled up to ``step`` with its ``ip_bucket``, dealt by ranges of (bucket, time, keys) once: the rollup and the table's layout share that shuffle.

    ``ip`` is one of ``keys``. The rows of a result are in one range, and a hot bucket's moment is many ranges if it has many keys.
    """
    rows = rows.select(*keys, "start", "stop", "packets", "eth_payload", "mtu").withColumn("ip_bucket", net.bucket(F.col(ip), buckets))
    rows = rows.withColumn("_slot", times.floor_to(F.col("start"), step)).repartitionByRange("ip_bucket", "_slot", *keys)
    return rollups.traffic_rollup(rows, [*keys, "ip_bucket", "_slot"], step).drop("_slot")


def write_levels(
    rows: DataFrame, root: str, metric: str, keys: list[str], ip: str, column: str = "rt", subnets: list[tuple[int, int]] | None = None, buckets: int = facts.BUCKETS
) -> None:
    """Append ``rows`` to the tables ``root/<metric>/<level>``, each level rolled up from the one before it as written.

    Traffic has sums and maxima, the others distributions ``column``; a level with step 0 has the rows as they are. Each level is read back from its
    own table, so the facts are rolled up once, and what a level appends is what its finer level appended in the same call.
    """
    spark, source = rows.sparkSession, rows
    for name, step in sorted(rollups.LEVELS[metric].items(), key=lambda x: x[1]):
        path = f"{root}/{metric}/{name}"
        if step and metric == "traffic":
            facts.write_dealt(dealt_rollup(source, keys, step, ip, buckets), path)
        else:
            facts.write_table(rollups.transaction_rollup(source, keys, step, column, subnets) if step else source, path, ip, "start", buckets)
        source = spark.read.parquet(path).drop("ip_bucket")


def read_levels(
    spark: SparkSession, root: str, metric: str, start: int, stop: int, columns: list[str], wanted: int | None = None, cidr: tuple[int, int] | None = None,
    ip: str = "ip_src", buckets: int = facts.BUCKETS,
) -> DataFrame:
    """``columns`` of the facts that begin in [start, stop[, from as few rows as the levels allow, with the ``level`` each row is of.

    Ranges of ``cover`` are read from their tables, with bucket, address and time in the scan; their union has every fact in one row exactly, so sums,
    maxima and merged distributions are those of the raw rows. Facts count by their beginning, as rollups round it. With ``wanted``, the step of a
    series, only levels that fit it are used.
    """
    parts = [
        facts.read_table(spark, f"{root}/{metric}/{name}", cidr=cidr, ip=ip, buckets=buckets, begins=(a, b)).select(*columns, F.lit(name).alias("level"))
        for name, a, b in cover(start, stop, fitting(metric, wanted))
    ]
    if not parts:
        name = next(iter(rollups.LEVELS[metric]))
        return spark.read.parquet(f"{root}/{metric}/{name}").select(*columns, F.lit(name).alias("level")).limit(0)
    return reduce(DataFrame.unionByName, parts)
