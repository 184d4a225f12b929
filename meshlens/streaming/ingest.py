"""Streams: the same rollups by event time, sessions, and matching of queries with answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(stream: DataFrame, ts: str, keys: list[str], step: str, delay: str, sums: list[str], maxima: list[str]) -> DataFrame:
    """Sums and maxima by keys and tumbling windows; late rows within ``delay`` count, none twice."""
    out = stream.withWatermark(ts, delay).groupBy(F.window(ts, step), *keys)
    out = out.agg(*[F.sum(c).cast("long").alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *keys, *sums, *maxima)


def rollup_levels(stream: DataFrame, ts: str, keys: list[str], steps: list[str], delay: str, sums: list[str], maxima: list[str]) -> list[DataFrame]:
    """Rollups by each of ``steps``, each level made of the one before in the same query, as tables are loaded in a chain.

    A level's window passes its event time on (``window_time``), so the watermark holds for the next level's state too, and a row is counted once
    a level. Steps must divide one another. Each result is a stream of its own with (start, stop, keys, sums, maxima).
    """
    rows, at, levels = stream.withWatermark(ts, delay), F.col(ts), []
    for step in steps:
        rows = rows.groupBy(F.window(at, step), *keys).agg(*[F.sum(c).cast("long").alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])
        levels.append(rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *keys, *sums, *maxima))
        at = F.window_time(F.col("window"))
    return levels


def merged(rows: DataFrame, keys: list[str], sums: list[str], maxima: list[str]) -> DataFrame:
    """Rows of a rollup's table as one a group: partial rows of the same group, as several loads append them, are merged."""
    return rows.groupBy("start", "stop", *keys).agg(*[F.sum(c).cast("long").alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])


def sessions(stream: DataFrame, ts: str, keys: list[str], gap: str, delay: str, size: str) -> DataFrame:
    """Packets of a key to flows that end after a gap."""
    out = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("packets"), F.sum(size).cast("long").alias(size))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), *keys, "packets", size)


def match(queries: DataFrame, answers: DataFrame, keys: list[str], timeout: str, delay: str, keep_unanswered: bool = False) -> DataFrame:
    """Each query (ts) with all answers (ts) to the same keys within ``timeout``; ``rt`` in seconds. ``packets.first_answers`` has one answer each.

    With ``keep_unanswered``, queries without an answer come out once the watermark has passed, with ``timed_out``.
    """
    q = queries.withWatermark("ts", delay).alias("q")
    a = answers.withWatermark("ts", delay).alias("a")
    same = [F.col(f"q.{k}") == F.col(f"a.{k}") for k in keys]
    within = F.expr(f"a.ts >= q.ts AND a.ts <= q.ts + INTERVAL {timeout}")
    condition = within
    for s in same:
        condition = condition & s
    out = q.join(a, condition, "leftOuter" if keep_unanswered else "inner")
    rt = F.coalesce((F.unix_micros(F.col("a.ts").cast("timestamp")) - F.unix_micros(F.col("q.ts").cast("timestamp"))) / 1e6, F.lit(0.0))
    return out.select(*[F.col(f"q.{k}").alias(k) for k in keys], F.col("q.ts").alias("ts"), rt.alias("rt"), F.col("a.ts").isNull().alias("timed_out"))
