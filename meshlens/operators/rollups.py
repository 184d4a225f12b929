"""Levels of detail: rollups of facts by rounded time, in chains, and the choice among them."""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.functions import addresses, times
from meshlens.functions.aggregates import merge_distributions
from meshlens.functions.labels import shorten_url

#: Levels of each metric with the step in milliseconds; 0 keeps rows as they are.
LEVELS = {
    "traffic": {"1min": 60_000, "10mins": 600_000, "1hour": 3_600_000},
    "dns": {"queries": 0, "1min": 60_000, "1hour": 3_600_000},
    "web": {"queries": 0, "1min": 60_000, "1hour": 3_600_000},
    "tcp": {"sockets": 0, "1hour": 3_600_000},
    "flow": {"flows": 0},
}


def traffic_rollup(df: DataFrame, keys: list[str], step: int, sums: tuple[str, ...] = ("packets", "eth_payload"), maxima: tuple[str, ...] = ("mtu",)) -> DataFrame:
    """Sums and maxima by keys and time rounded outwards to ``step``; a rollup may be rolled up again."""
    start, stop = times.round_interval(F.col("start"), F.col("stop"), step)
    rounded = df.withColumns({"_a": start, "_b": stop}).drop("start", "stop").withColumnsRenamed({"_a": "start", "_b": "stop"})
    aggs = [F.sum(c).cast("long").alias(c) for c in sums] + [F.max(c).alias(c) for c in maxima]
    return rounded.groupBy(*keys, "start", "stop").agg(*aggs)


def client_subnets(df: DataFrame, subnets: list[tuple[int, int] | str], ip: str = "ip_clt", mask: str = "mask_clt") -> DataFrame:
    """``df`` with its clients degraded to the first configured subnet with them: ``ip`` its network, ``mask`` its length; a host stays one.

    ``ip`` is a number or a struct of ``addresses``; rows that have ``mask`` already are left as they are.
    """
    if mask in df.columns:
        return df
    texts = [x if isinstance(x, str) else f"{ipaddress.ip_address(x[0])}/{x[1]}" for x in subnets]
    number = df.schema[ip].dataType.simpleString() != addresses.ADDRESS
    own = df.withColumn("_client", addresses.from_number(F.col(ip)) if number else F.col(ip))
    out = addresses.subnet_of(own, "_client", addresses.subnet_table(df.sparkSession, texts), "_net", mask)
    return out.withColumn(ip, addresses.to_number(F.col("_net")) if number else F.col("_net")).drop("_client", "_net")


def transaction_rollup(
    df: DataFrame, keys: list[str], step: int, column: str = "rt", subnets: list[tuple[int, int] | str] | None = None, sums: tuple[str, ...] = ()
) -> DataFrame:
    """Distributions merged by keys and floored time, and sums such as the SYNs of sockets.

    With ``subnets``, clients among the keys are degraded to subnets (``mask_clt`` is added to the keys), so a rollup can be filtered by client
    again; urls are cut at their query, client ports cleared. A rollup may be rolled up again.
    """
    if "ip_clt" in keys and subnets is not None:
        df = client_subnets(df, subnets)
    if "ip_clt" in keys and "mask_clt" in df.columns and "mask_clt" not in keys:
        keys = [*keys, "mask_clt"]
    changes = {"start": times.floor_to(F.col("start"), step)}
    if "url" in keys:
        changes["url"] = shorten_url(F.col("url"))
    if "port_clt" in keys:
        changes["port_clt"] = F.lit(0)
    return merge_distributions(df.withColumns(changes), [*keys, "start"], column, sums=sums)


def level_for(metric: str, step: int) -> str:
    """The coarsest level whose rounding is within the step asked for, else the finest."""
    fitting = [(s, name) for name, s in LEVELS[metric].items() if s <= step]
    return max(fitting)[1] if fitting else min((s, name) for name, s in LEVELS[metric].items())[1]
