"""Peer graphs, maps and call flows."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlens.operators.top import clipped


def network_graph(
    df: DataFrame, a: str, b: str, value: str, start: int | None = None, stop: int | None = None, min_volume: int = 0, signed: bool = True, descending: bool = False
) -> DataFrame:
    """Undirected edges (node1, node2, y): what goes from the first node to the second counts, what comes back is taken off.

    Nodes are ordered by value, ``descending`` for hardware addresses. With ``signed`` the threshold is on the
    signed volume, which drops edges that the reverse direction dominates, else on its size.
    """
    forward = F.col(a) >= F.col(b) if descending else F.col(a) <= F.col(b)
    y = clipped(F.col(value), start, stop)
    edges = df.select(
        F.when(forward, F.col(a)).otherwise(F.col(b)).alias("node1"), F.when(forward, F.col(b)).otherwise(F.col(a)).alias("node2"),
        F.when(forward, y).otherwise(-y).alias("y"),
    )
    out = edges.groupBy("node1", "node2").agg(F.sum("y").cast("long").alias("y"))
    return out.where((F.col("y") if signed else F.abs("y")) >= min_volume) if min_volume else out


def network_map(df: DataFrame, max_ips: int = 10, min_volume: int = 0) -> DataFrame:
    """Volumes between places, up and down apart, with some of the addresses of each end.

    ``df`` has src_/dst_ country, lat, lon, ip_src, ip_dst and y. Lists of addresses are sorted and cut to ``max_ips``, as
    the feature has it; candidates are kept distinct before they are gathered.
    """
    a, b = (F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ("country", "lat", "lon")]) for s in ("src", "dst"))
    forward = a <= b
    rows = df.select(
        F.when(forward, a).otherwise(b).alias("p1"), F.when(forward, b).otherwise(a).alias("p2"),
        F.when(forward, F.col("ip_src")).otherwise(F.col("ip_dst")).alias("ip1"), F.when(forward, F.col("ip_dst")).otherwise(F.col("ip_src")).alias("ip2"),
        F.when(forward, F.col("y")).otherwise(0).alias("up"), F.when(forward, F.lit(0)).otherwise(F.col("y")).alias("down"),
    )
    sums = rows.groupBy("p1", "p2").agg(F.sum("up").cast("long").alias("up"), F.sum("down").cast("long").alias("down"))
    for side in ("1", "2"):
        ips = rows.select("p1", "p2", f"ip{side}").distinct()
        first = ips.withColumn("_n", F.row_number().over(Window.partitionBy("p1", "p2").orderBy(f"ip{side}"))).where(F.col("_n") <= max_ips)
        sums = sums.join(first.groupBy("p1", "p2").agg(F.sort_array(F.collect_list(f"ip{side}")).alias(f"ips{side}")), ["p1", "p2"])
    return sums.where(F.col("up") + F.col("down") >= min_volume)


def peers(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Volume of each ordered pair."""
    return df.groupBy(a, b).agg(F.sum(value).cast("long").alias("y"))


def peer_totals(edges: DataFrame, a: str, b: str, y: str = "y") -> DataFrame:
    """(node, up, down): what each node sent and got."""
    sent = edges.select(F.col(a).alias("node"), F.col(y).alias("up"), F.lit(0).cast("long").alias("down"))
    got = edges.select(F.col(b).alias("node"), F.lit(0).cast("long").alias("up"), F.col(y).alias("down"))
    return sent.unionByName(got).groupBy("node").agg(F.sum("up").cast("long").alias("up"), F.sum("down").cast("long").alias("down"))


def neighbours(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, degree): number of distinct nodes each node is linked to."""
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(b, a)).distinct()
    return both.groupBy("node").agg(F.count("*").alias("degree"))


def callflow(flows: DataFrame, host: int, start: int, stop: int, max_hops: int | None = None) -> DataFrame:
    """Flows that ``host`` may have caused within [start, stop[: (hop, ip_src, ip_dst, start, stop, y).

    Breadth first: each hop takes all flows from its hosts that overlap the time in which they were first reached until
    the last flow that reached them, never beyond ``stop``; every host is expanded once, with its earliest
    window. It goes on until no new host is left, or for ``max_hops``. The frontier of a hop and the hosts
    seen are checkpointed tables; nothing but "is it empty" reaches the driver.
    """
    spark = flows.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    frontier = spark.createDataFrame([(host, start, stop - 1)], "node long, t0 long, t1 long")
    seen, out = frontier.select("node"), None
    for hop in itertools.count(1) if max_hops is None else range(1, max_hops + 1):
        found = flows.join(frontier, (flows.ip_src == frontier.node) & (flows.stop >= frontier.t0) & (flows.start <= frontier.t1))
        found = found.select(F.lit(hop).alias("hop"), "ip_src", "ip_dst", "start", "stop", "y", "t0").checkpoint()
        if found.isEmpty():
            break
        out = found.drop("t0") if out is None else out.unionByName(found.drop("t0"))
        reach = found.groupBy(F.col("ip_dst").alias("node")).agg(F.min(F.greatest("start", "t0")).alias("t0"), F.max(F.least("stop", F.lit(stop - 1))).alias("t1"))
        frontier = reach.join(seen, "node", "left_anti").checkpoint()
        seen = seen.unionByName(frontier.select("node"))
        if frontier.isEmpty():
            break
    empty = spark.createDataFrame([], "hop int, ip_src long, ip_dst long, start long, stop long, y long")
    return out if out is not None else empty
