"""Registered queries of the traffic engine over the driver's tables, each with the same in DuckDB's SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.functions import addresses, aggregates, labels, net, numbers, times
from meshlens.operators import callflow as callflows
from meshlens.operators import graphs, presets, rollups, series, top
from meshlens.sources import facts, levels, segments, staging
from meshlens.streaming import packets

#: The queries' time: the first half of 1996 in weeks; January 2024 in hours for transactions.
START, STOP, WEEK = 820_454_400_000, 836_179_200_000, 604_800_000
TX_START, TX_STOP, HOUR = 1_704_067_200_000, 1_704_672_000_000, 3_600_000
TEN8, NET192 = 10 << 24, 3_232_235_520

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None = None):
    def add(f):
        text = sql
        if text is not None:
            needed = set(re.findall(r"(?:FROM|JOIN) (traffic|tx|web|tcp|packets)\b", text))
            needed |= {"tx"} if needed & {"web", "tcp"} else set()
            views = [v for k, v in (("traffic", facts.TRAFFIC_SQL), ("tx", facts.TRANSACTIONS_SQL), ("web", facts.WEB_SQL), ("tcp", facts.TCP_SQL), ("packets", facts.PACKETS_SQL)) if k in needed]
            text = f"WITH {', '.join(views)}{', ' if text.startswith('+') else ' '}{text.lstrip('+')}" if views else text
        _QUERIES[f.__name__] = (f, text)
        return f

    return add


def _clip(value: str, a: int = START, b: int = STOP) -> str:
    first = f"(CASE WHEN start < {a} THEN ({value}) * (stop - {a}) // greatest(stop - start, 1) ELSE ({value}) END)"
    return (
        f"(CASE WHEN stop > {b} THEN {first} * ({b} - greatest(start, {a})) // greatest(stop - greatest(start, {a}), 1) ELSE {first} END)"
    )


INSIDE = f"stop >= {START} AND start < {STOP}"


def _inside(spark, d):
    return presets.traffic(facts.traffic(spark, d), start=START, stop=STOP)


# Scans, projections and preset filters


@_query("SELECT start, stop, ip_src, eth_payload FROM traffic WHERE ip_proto = 6")
def scan_project(spark, d):
    return presets.traffic(facts.traffic(spark, d), ip_proto=6).select("start", "stop", "ip_src", "eth_payload")


@_query("SELECT count(*) AS n, CAST(sum(packets) AS BIGINT) AS packets FROM traffic WHERE (packets + 1) * 2 > 60 AND eth_payload // packets >= 1000")
def filter_expr_arith(spark, d):
    out = presets.traffic(facts.traffic(spark, d), where="(packets + 1) * 2 > 60 AND eth_payload div packets >= 1000")
    return out.agg(F.count("*").alias("n"), aggregates.sum_int(F.col("packets")).alias("packets"))


@_query("SELECT ip_proto, count(*) AS n FROM traffic WHERE NOT (ip_proto = 6 OR port_dst <> 200) OR mtu > 1405 GROUP BY 1")
def filter_expr_logic(spark, d):
    out = presets.traffic(facts.traffic(spark, d), where="NOT (ip_proto = 6 OR port_dst <> 200) OR mtu > 1405")
    return out.groupBy("ip_proto").agg(F.count("*").alias("n"))


@_query("SELECT name, count(*) AS n FROM tx WHERE starts_with(name, 's') GROUP BY 1")
def filter_starts_with(spark, d):
    return presets.transactions(facts.transactions(spark, d), where="startswith(name, 's')").groupBy("name").agg(F.count("*").alias("n"))


@_query("SELECT name, count(*) AS n FROM tx WHERE contains(name, 'i') GROUP BY 1")
def filter_contains(spark, d):
    return presets.transactions(facts.transactions(spark, d), where=F.col("name").contains("i")).groupBy("name").agg(F.count("*").alias("n"))


@_query(f"SELECT start, stop, packets FROM traffic WHERE {INSIDE}")
def time_overlap(spark, d):
    return _inside(spark, d).select("start", "stop", "packets")


@_query(f"SELECT ip_src, count(*) AS n FROM traffic WHERE ip_src >> 5 = {TEN8 >> 5} GROUP BY 1")
def in_cidr(spark, d):
    return presets.traffic(facts.traffic(spark, d), ip_src=(TEN8, 27)).groupBy("ip_src").agg(F.count("*").alias("n"))


@_query(f"SELECT m, count(*) AS n FROM (SELECT ip_clt, CAST(24 + event_id % 8 AS INT) AS m FROM tx) WHERE ip_clt >> (32 - least(m, 26)) = ({NET192} + 64) >> (32 - least(m, 26)) GROUP BY 1")
def inter_cidr(spark, d):
    rows = facts.transactions(spark, d).select("ip_clt", (24 + F.col("event_id") % 8).cast("int").alias("m"))
    return rows.where(net.inter_cidr(F.col("ip_clt"), F.col("m"), NET192 + 64, 26)).groupBy("m").agg(F.count("*").alias("n"))


@_query(f"SELECT count(*) AS n FROM traffic WHERE ip_src = {TEN8 + 3} OR ip_dst = {TEN8 + 3} OR ip_src >> 8 = {NET192 >> 8} OR ip_dst >> 8 = {NET192 >> 8}")
def either_side_ip(spark, d):
    rows = facts.traffic(spark, d)
    host = presets.traffic(rows, ip=TEN8 + 3)
    others = presets.traffic(presets.traffic(rows, ip=(NET192, 24)), where=F.col("ip_src") != TEN8 + 3)
    return host.unionByName(others).agg(F.count("*").alias("n"))


@_query("SELECT port_src, port_dst, count(*) AS n FROM traffic WHERE port_src = 1100 OR port_dst = 1100 GROUP BY 1, 2")
def either_side_port(spark, d):
    return presets.traffic(facts.traffic(spark, d), port=1100).groupBy("port_src", "port_dst").agg(F.count("*").alias("n"))


@_query("SELECT vlan, count(*) AS n FROM traffic WHERE vlan IS NULL OR vlan = 3 GROUP BY 1")
def vlan_null_safe(spark, d):
    rows = facts.traffic(spark, d)
    both = presets.traffic(rows, no_vlan=True).unionByName(presets.traffic(rows, vlan=3))
    return both.groupBy("vlan").agg(F.count("*").alias("n"))


@_query("SELECT name, error, count(*) AS n FROM tx WHERE suffix(name, 'up') OR (error = 3 AND suffix(name, 'or')) GROUP BY 1, 2")
def qname_suffix(spark, d):
    rows = facts.transactions(spark, d)
    return presets.transactions(rows, qname="up").unionByName(presets.transactions(rows, qname="or", error=3)).groupBy("name", "error").agg(F.count("*").alias("n"))


@_query("SELECT count(*) AS n, count(DISTINCT url) AS urls FROM pages WHERE starts_with(url, 'https://blog')")
def url_prefix(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("url")
    return pages.where(F.col("url").startswith("https://blog")).agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


@_query("SELECT split_part(url, '?', 1) AS url, count(*) AS n FROM pages GROUP BY 1")
def shorten_url(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").groupBy(labels.shorten_url(F.col("url")).alias("url")).agg(F.count("*").alias("n"))


@_query("SELECT ip_srv, count(*) AS n FROM tx WHERE rt >= 0.05 AND rt <= 0.1 GROUP BY 1")
def rt_range(spark, d):
    return presets.transactions(facts.transactions(spark, d), rt_min=0.05, rt_max=0.1, rt="rt").groupBy("ip_srv").agg(F.count("*").alias("n"))


# Aggregates


@_query("SELECT ip_proto, vlan, max(mtu) AS mx, min(mtu) AS mn, CAST(sum(packets) AS BIGINT) AS s, CAST(sum(eth_payload) AS BIGINT) // count(*) AS a, count(*) AS n FROM traffic GROUP BY 1, 2")
def agg_int_all(spark, d):
    a = aggregates
    return facts.traffic(spark, d).groupBy("ip_proto", "vlan").agg(
        a.max_int(F.col("mtu")).alias("mx"), a.min_int(F.col("mtu")).alias("mn"), a.sum_int(F.col("packets")).alias("s"),
        a.avg_int(F.col("eth_payload")).alias("a"), F.count("*").alias("n"),
    )


@_query("SELECT port_dst, CAST(sum(packets) AS BIGINT) // count(*) AS a FROM traffic GROUP BY 1")
def agg_avg_int_trunc(spark, d):
    return facts.traffic(spark, d).groupBy("port_dst").agg(aggregates.avg_int(F.col("packets")).alias("a"))


@_query("SELECT ip_proto, min(start) AS first, max(stop) AS last FROM traffic GROUP BY 1")
def agg_bounds(spark, d):
    return facts.traffic(spark, d).groupBy("ip_proto").agg(F.min("start").alias("first"), F.max("stop").alias("last"))


_DIST = "count(*) AS n, round(min(rt), 6) AS lo, round(max(rt), 6) AS hi, round(avg(rt), 6) AS av, round(var_pop(rt) * count(*), 4) AS m2"


def _flat(out: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    r = F.col("rt")
    return out.select(*keys, r["count"].alias("n"), *[F.round(r[c], k).alias(x) for c, k, x in (("min", digits, "lo"), ("max", digits, "hi"), ("avg", digits, "av"), ("m2", digits * 3 // 4 if digits > 6 else 4, "m2"))])


@_query(f"SELECT name, {_DIST} FROM tx GROUP BY 1")
def distribution_build(spark, d):
    return _flat(facts.transactions(spark, d).groupBy("name").agg(aggregates.distribution(F.col("rt")).alias("rt")), "name")


@_query(f"SELECT ip_srv, {_DIST} FROM tx GROUP BY 1")
def distribution_merge(spark, d):
    parts = facts.transactions(spark, d).groupBy("ip_srv", "name").agg(aggregates.distribution(F.col("rt")).alias("rt"))
    return _flat(aggregates.merge_distributions(parts, ["ip_srv"], "rt"), "ip_srv")


@_query("SELECT ip_srv, start // 3600000 AS h, round(coalesce(stddev_samp(rt), 0), 6) AS sd FROM tx GROUP BY 1, 2")
def std_dev_zero(spark, d):
    rows = facts.transactions(spark, d).groupBy("ip_srv", times.div(F.col("start"), HOUR).alias("h")).agg(aggregates.distribution(F.col("rt")).alias("rt"))
    return rows.select("ip_srv", "h", F.round(aggregates.std_dev(F.col("rt.count"), F.col("rt.m2")), 6).alias("sd"))


# Time series

_ROWS = (TX_STOP - TX_START) // HOUR + 1


@_query(f"""+b AS (SELECT (start - {TX_START}) // {HOUR} AS row, count(*) AS count, min(rt) AS lo, max(rt) AS hi, avg(rt) AS av, coalesce(stddev_samp(rt), 0) AS sd
 FROM tx WHERE start >= {TX_START} AND start < {TX_STOP} GROUP BY 1)
SELECT r AS row, coalesce(count, 0) AS count, round(coalesce(lo, 0), 6) AS lo, round(coalesce(hi, 0), 6) AS hi, round(coalesce(av, 0), 6) AS av, round(coalesce(sd, 0), 6) AS sd
 FROM range({_ROWS}) t(r) LEFT JOIN b ON b.row = r""")
def per_date_resp_time(spark, d):
    out = series.per_date(facts.transactions(spark, d), "rt", TX_START, TX_STOP, HOUR)
    return out.select("row", "count", *[F.round(c, 6).alias(x) for c, x in (("min", "lo"), ("max", "hi"), ("avg", "av"), ("std", "sd"))])


def _spread_sql(keys: str, value: str = "eth_payload", rounded: bool = True, source: str = "traffic") -> str:
    half = " + (z - a + 1) // 2" if rounded else ""
    return f"""c AS (SELECT {keys}, {_clip(value)} AS y0, (greatest(start, {START}) - {START}) // {WEEK} AS a,
 greatest((greatest(start, {START}) - {START}) // {WEEK}, (least(stop, {STOP}) - {START}) // {WEEK} - 1) AS z FROM {source} WHERE {INSIDE}),
s AS (SELECT {keys.split(' AS ')[-1]} AS k, row, CAST(sum(y1) AS BIGINT) AS y FROM (SELECT *, (y0{half}) // (z - a + 1) AS y1, unnest(range(a, z + 1)) AS row FROM c) GROUP BY 1, 2)"""


def _ranked_sql(n: int) -> str:
    return f""", p AS (SELECT k, max(y) AS peak FROM s GROUP BY 1 ORDER BY 2 DESC, k NULLS FIRST LIMIT {n - 1})
SELECT CASE WHEN p.peak IS NOT NULL THEN s.k END AS k, p.peak IS NULL AS is_others, row, CAST(sum(y) AS BIGINT) AS y
 FROM s LEFT JOIN p ON s.k IS NOT DISTINCT FROM p.k GROUP BY 1, 2, 3"""


@_query("+" + _spread_sql("least(port_src, port_dst) AS k") + _ranked_sql(4))
def per_time_app(spark, d):
    rows = _inside(spark, d).withColumn("k", F.least("port_src", "port_dst"))
    return series.ranked(series.spread(rows, ["k"], "eth_payload", START, STOP, WEEK), "k", 4)


@_query("+" + _spread_sql("mac_src AS k") + _ranked_sql(5))
def per_time_eth(spark, d):
    return series.ranked(series.spread(_inside(spark, d).withColumnRenamed("mac_src", "k"), ["k"], "eth_payload", START, STOP, WEEK), "k", 5)


@_query("+" + _spread_sql("ip_src AS k", rounded=False) + f""", v AS (SELECT ip_src, sum({_clip('eth_payload')}) AS v FROM traffic WHERE {INSIDE} GROUP BY 1),
g AS (SELECT ip_src FROM v WHERE v >= (SELECT CAST(sum(v) AS BIGINT) // 60 FROM v))
SELECT CASE WHEN g.ip_src IS NOT NULL THEN k END AS k, row, CAST(sum(y) AS BIGINT) AS y FROM s LEFT JOIN g ON k = g.ip_src GROUP BY 1, 2""")
def per_time_ip_others(spark, d):
    rows = _inside(spark, d).withColumnRenamed("ip_src", "k")
    big = top.significant(rows.select("k", top.clipped(F.col("eth_payload"), START, STOP).alias("y")), ["k"], "y", 60).where("NOT is_rest")
    s = series.spread(rows, ["k"], "eth_payload", START, STOP, WEEK, rounded=False)
    out = s.join(F.broadcast(big.select(F.col("k").alias("g"))), F.col("k") == F.col("g"), "left")  # at most 60 keys
    return out.groupBy(F.col("g").alias("k"), "row").agg(F.sum("y").cast("long").alias("y"))


@_query(f"SELECT ip_proto, CAST(sum({_clip('eth_payload')}) AS BIGINT) AS y FROM traffic WHERE {INSIDE} GROUP BY 1")
def clip_total(spark, d):
    y = top.clipped(F.col("eth_payload"), START, STOP)
    return _inside(spark, d).groupBy("ip_proto").agg(F.sum(y).cast("long").alias("y"))


@_query("+" + _spread_sql("ip_proto AS k") + f" SELECT k, row, y, round(y / {WEEK / 1000}, 6) AS rate FROM s")
def rate_per_sec(spark, d):
    s = series.spread(_inside(spark, d).withColumnRenamed("ip_proto", "k"), ["k"], "eth_payload", START, STOP, WEEK)
    return series.rates(s, WEEK).withColumn("rate", F.round("rate", 6))


@_query("+" + _spread_sql("ip_proto AS k") + " SELECT k, row, y, CAST(sum(y) OVER (PARTITION BY row ORDER BY k) AS BIGINT) AS stacked FROM s")
def stacked_running_sum(spark, d):
    s = series.spread(_inside(spark, d).withColumnRenamed("ip_proto", "k"), ["k"], "eth_payload", START, STOP, WEEK)
    return top.stacked(s, "k", "row", "y")


@_query("+" + _spread_sql("port_dst AS k") + " SELECT k, CAST(sum(y) AS BIGINT) AS total, round(avg(y), 4) AS average, max(y) AS peak, row_number() OVER (ORDER BY max(y) DESC, k) AS rank FROM s GROUP BY k")
def series_positions(spark, d):
    s = series.spread(_inside(spark, d).withColumnRenamed("port_dst", "k"), ["k"], "eth_payload", START, STOP, WEEK)
    return series.positions(s, "k").withColumns({"average": F.round("average", 4), "rank": F.col("rank").cast("long")})


# Top-N


@_query("""+v AS (SELECT ip_src, CAST(sum(eth_payload) AS BIGINT) AS v FROM traffic GROUP BY 1), t AS (SELECT CAST(sum(v) AS BIGINT) // 80 AS t FROM v)
SELECT CASE WHEN v >= t THEN ip_src END AS ip_src, v < t AS is_rest, CAST(sum(v) AS BIGINT) AS v FROM v, t GROUP BY 1, 2""")
def significant_keys(spark, d):
    return top.significant(facts.traffic(spark, d), ["ip_src"], "eth_payload", 80)


def _top_sql(keys: list[str], sort: str, aggs: dict[str, str], n: int, where: str, clip: bool) -> str:
    k, value = ", ".join(keys), _clip(sort) if clip else sort
    a = ", ".join(f"{x} AS {name}" for name, x in aggs.items())
    same = " AND ".join(f"f.{x} IS NOT DISTINCT FROM b.{x}" for x in keys)
    shown = ", ".join(f"CASE WHEN b.y IS NOT NULL THEN f.{x} END AS {x}" for x in keys)
    return f"""+f AS (SELECT * FROM traffic WHERE {where}), b AS (SELECT {k}, sum({value}) AS y FROM f GROUP BY ALL ORDER BY y DESC, {', '.join(f'{x} NULLS FIRST' for x in keys)} LIMIT {n}),
m AS (SELECT f.* EXCLUDE ({k}), {shown}, b.y IS NOT NULL AS best FROM f LEFT JOIN b ON {same})
SELECT {k}, CASE WHEN best THEN 'key' ELSE 'others' END AS kind, CAST(sum({value}) AS BIGINT) AS sort_value, {a} FROM m GROUP BY best, {k}
UNION ALL SELECT {', '.join('NULL' for _ in keys)}, 'total', CAST(sum({value}) AS BIGINT), {', '.join(aggs.values())} FROM f"""


_AGGS = {"packets": "CAST(sum(packets) AS BIGINT)", "mtu": "max(mtu)", "size": "CAST(sum(eth_payload) AS BIGINT) // count(eth_payload)"}
_AGGREGATES = {"packets": ("sum", "packets"), "mtu": ("max", "mtu"), "size": ("avg", "eth_payload")}


@_query(_top_sql(["ip_src"], "eth_payload", _AGGS, 10, "ip_proto = 6", False))
def top_others_total(spark, d):
    return top.top(presets.traffic(facts.traffic(spark, d), ip_proto=6), ["ip_src"], _AGGREGATES, "eth_payload", 10)


@_query(_top_sql(["vlan", "port_dst"], "packets", _AGGS, 12, INSIDE, True))
def top_single_pass(spark, d):
    return top.top(_inside(spark, d), ["vlan", "port_dst"], _AGGREGATES, "packets", 12, START, STOP)


@_query(f"""{_top_sql(["port_dst"], "eth_payload", {}, 3, "ip_proto = 6", False).replace("sort_value,", "sort_value").replace(", FROM", " FROM")}""".replace("SELECT port_dst, CASE WHEN best", "SELECT *, CAST(row_number() OVER (ORDER BY CASE kind WHEN 'key' THEN 0 WHEN 'others' THEN 1 ELSE 2 END, sort_value DESC, port_dst) AS INT) AS rank FROM (SELECT port_dst, CASE WHEN best") + ")")
def top_ranked(spark, d):
    """The three ports with the most payload, the others and the total, with their rank."""
    return top.top(presets.traffic(facts.traffic(spark, d), ip_proto=6), ["port_dst"], {}, "eth_payload", 3, ranked=True)


@_query(f"""SELECT ip_srv, CAST(sum(rt_count) AS BIGINT) AS queries, max(start + CAST(floor(rt_max * 1000) AS BIGINT)) AS stop FROM web WHERE start + CAST(floor(rt_max * 1000) AS BIGINT) >= {TX_START + HOUR} GROUP BY 1""")
def virtual_fields(spark, d):
    rows = presets.transactions(presets.with_virtual(facts.web(spark, d)), where=F.col("stop") >= TX_START + HOUR)
    return rows.groupBy("ip_srv").agg(F.sum("queries").alias("queries"), F.max("stop").alias("stop"))


@_query("SELECT event_id, ip_srv, name, rt FROM tx ORDER BY rt, event_id LIMIT 30")
def top_requests_asc(spark, d):
    return top.top_rows(facts.transactions(spark, d), "rt", 30, False, "event_id").select("event_id", "ip_srv", "name", "rt")


@_query("SELECT event_id, ip_srv, name, rt FROM tx ORDER BY rt DESC, event_id LIMIT 30")
def top_requests_desc(spark, d):
    return top.top_rows(facts.transactions(spark, d), "rt", 30, True, "event_id").select("event_id", "ip_srv", "name", "rt")


@_query("SELECT name, CAST(floor(rt / 0.01) AS BIGINT) AS bucket, count(*) AS n FROM tx GROUP BY 1, 2")
def resp_time_histogram(spark, d):
    return series.histogram(facts.transactions(spark, d), "name", "rt", 0.01)


@_query("""+r AS (SELECT min(rt) AS a, max(rt) AS b FROM tx), w AS (SELECT CASE WHEN b > a THEN pow(2.0, ceil(log2((b - a) / 200))) ELSE 1.0 END AS width FROM r)
SELECT name, CAST(floor(rt / width) AS BIGINT) AS bucket, width, count(*) AS n FROM tx, w GROUP BY 1, 2, 3""")
def resp_time_histogram_auto(spark, d):
    """Response times by buckets of a width that nobody gave."""
    return series.histogram_of_unknown_range(facts.transactions(spark, d), "name", "rt")


@_query("""+v AS (SELECT mac_src, mac_dst, CAST(sum(eth_payload) AS BIGINT) AS v FROM traffic GROUP BY 1, 2), t AS (SELECT CAST(sum(v) AS BIGINT) // 250 AS t FROM v)
SELECT CASE WHEN v >= t THEN mac_src END AS mac_src, CASE WHEN v >= t THEN mac_dst END AS mac_dst, v < t AS is_rest, CAST(sum(v) AS BIGINT) AS v FROM v, t GROUP BY 1, 2, 3""")
def peers_significant(spark, d):
    """Pairs with more than a 250th of all volume, and the others."""
    return top.significant_two_pass(facts.traffic(spark, d), ["mac_src", "mac_dst"], "eth_payload", 250)


@_query("+v AS (SELECT port_dst, CAST(sum(packets) AS BIGINT) AS v FROM traffic GROUP BY 1) SELECT port_dst, v, CAST(sum(v) OVER () AS BIGINT) AS total, round(v / sum(v) OVER (), 9) AS share, round(v / max(v) OVER (), 9) AS weight FROM v")
def share_of_total(spark, d):
    v = facts.traffic(spark, d).groupBy("port_dst").agg(F.sum("packets").cast("long").alias("v"))
    return top.weights(top.share(v, "v"), "v").withColumns({"share": F.round("share", 9), "weight": F.round("weight", 9)})


@_query(None)
def heavy_hitters_approx(spark, d):
    return top.heavy_hitters(facts.traffic(spark, d), "ip_src", "eth_payload", 120)


# Graphs


@_query("SELECT ip_src, ip_dst, CAST(sum(eth_payload) AS BIGINT) AS y FROM traffic GROUP BY 1, 2")
def peers_ip(spark, d):
    return graphs.peers(facts.traffic(spark, d), "ip_src", "ip_dst", "eth_payload")


@_query("SELECT mac_src, mac_dst, CAST(sum(eth_payload) AS BIGINT) AS y FROM traffic GROUP BY 1, 2")
def peers_mac(spark, d):
    return graphs.peers(facts.traffic(spark, d), "mac_src", "mac_dst", "eth_payload")


def _graph_sql(having: str = "") -> str:
    y = _clip("eth_payload")
    return f"""SELECT greatest(mac_src, mac_dst) AS node1, least(mac_src, mac_dst) AS node2, CAST(sum(CASE WHEN mac_src >= mac_dst THEN {y} ELSE -{y} END) AS BIGINT) AS y
 FROM traffic WHERE {INSIDE} GROUP BY 1, 2{having}"""


@_query(_graph_sql())
def network_graph_signed(spark, d):
    return graphs.network_graph(_inside(spark, d), "mac_src", "mac_dst", "eth_payload", START, STOP, descending=True)


@_query(_graph_sql(" HAVING y >= 20000000"))
def network_graph_min_volume(spark, d):
    return graphs.network_graph(_inside(spark, d), "mac_src", "mac_dst", "eth_payload", START, STOP, min_volume=20_000_000, descending=True)


def _geo(spark, d) -> DataFrame:
    """Ranges of 64 addresses of suppliers and customers, with their nation as the country."""
    nation = spark.read.parquet(f"{d}/nation.parquet")
    key = F.col("n_nationkey").cast("long")
    out = None
    for base in (TEN8, NET192):
        low = F.lit(base).cast("long") + key * 64
        part = nation.select(low.alias("low"), (low + 63).alias("high"), F.col("n_name").alias("country"), (key * 1.5).alias("lat"), (key * -2.5).alias("lon"))
        out = part if out is None else out.unionByName(part)
    return out


@_query(f"""+geo AS (SELECT b + n_nationkey * 64 AS low, b + n_nationkey * 64 + 63 AS high, n_name AS country FROM nation, (VALUES ({TEN8}::BIGINT), ({NET192}::BIGINT)) v(b)),
r AS (SELECT coalesce(g.country, '') AS a, coalesce(h.country, '') AS b, ip_src, ip_dst, eth_payload AS y FROM traffic LEFT JOIN geo g ON ip_src BETWEEN g.low AND g.high LEFT JOIN geo h ON ip_dst BETWEEN h.low AND h.high),
o AS (SELECT least(a, b) AS c1, greatest(a, b) AS c2, CASE WHEN a <= b THEN ip_src ELSE ip_dst END AS ip1, CASE WHEN a <= b THEN y ELSE 0 END AS up, CASE WHEN a <= b THEN 0 ELSE y END AS down FROM r)
SELECT c1, c2, CAST(sum(up) AS BIGINT) AS up, CAST(sum(down) AS BIGINT) AS down, array_to_string(list_slice(list_sort(list_distinct(list(ip1))), 1, 10), ',') AS ips1 FROM o GROUP BY 1, 2 HAVING sum(up) + sum(down) >= 100000""")
def network_map(spark, d):
    geo = _geo(spark, d)
    rows = facts.geo_join(facts.geo_join(facts.traffic(spark, d), "ip_src", geo, "src_"), "ip_dst", geo, "dst_")
    out = graphs.network_map(rows.withColumnRenamed("eth_payload", "y"), min_volume=100_000)
    return out.select(F.col("p1.country").alias("c1"), F.col("p2.country").alias("c2"), "up", "down", F.array_join("ips1", ",").alias("ips1"))


@_query("""SELECT node, CAST(sum(up) AS BIGINT) AS up, CAST(sum(down) AS BIGINT) AS down FROM (SELECT mac_src AS node, eth_payload AS up, 0 AS down FROM traffic
 UNION ALL SELECT mac_dst, 0, eth_payload FROM traffic) GROUP BY 1""")
def peer_totals(spark, d):
    edges = graphs.peers(facts.traffic(spark, d), "mac_src", "mac_dst", "eth_payload")
    return graphs.peer_totals(edges, "mac_src", "mac_dst")


@_query("SELECT node, count(DISTINCT other) AS degree FROM (SELECT ip_src AS node, ip_dst AS other FROM traffic UNION ALL SELECT ip_dst, ip_src FROM traffic) GROUP BY 1")
def connected_to(spark, d):
    return graphs.neighbours(facts.traffic(spark, d), "ip_src", "ip_dst")


def _flows(spark, d) -> DataFrame:
    """Traffic among 40 hosts, with directions both ways."""
    t = facts.traffic(spark, d)
    return t.select((F.col("ip_src") % 40).alias("ip_src"), (F.col("ip_dst") % 40).alias("ip_dst"), "start", "stop", F.col("eth_payload").alias("y"))


def _callflow_sql(hops: int) -> str:
    """Hop by hop, as often as there are hosts."""
    parts = [
        f"f AS MATERIALIZED (SELECT ip_src % 40 AS ip_src, ip_dst % 40 AS ip_dst, start, stop, eth_payload AS y FROM traffic WHERE stop >= {START} AND start < {START + 4 * WEEK})",
        f"r0 AS (SELECT 7::BIGINT AS node, {START}::BIGINT AS t0, {START + 4 * WEEK - 1}::BIGINT AS t1)", "v0 AS (SELECT node FROM r0)",
    ]
    for k in range(1, hops + 1):
        parts += [
            f"h{k} AS MATERIALIZED (SELECT f.*, t0 FROM f JOIN r{k - 1} ON ip_src = node AND stop >= t0 AND start <= t1)",
            f"r{k} AS MATERIALIZED (SELECT ip_dst AS node, min(greatest(start, t0)) AS t0, max(least(stop, {START + 4 * WEEK - 1})) AS t1 FROM h{k} WHERE ip_dst NOT IN (FROM v{k - 1}) GROUP BY 1)",
            f"v{k} AS MATERIALIZED (SELECT node FROM v{k - 1} UNION ALL SELECT node FROM r{k})",
        ]
    return "+" + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS hop, ip_src, ip_dst, start, stop, y FROM h{k}" for k in range(1, hops + 1))


@_query(_callflow_sql(40))
def callflow(spark, d):
    """All flows that host 7 may have caused in four weeks."""
    return graphs.callflow(_flows(spark, d), 7, START, START + 4 * WEEK)


#: Hosts of the call flow in both directions.
PARTIES = 20


def _conversing(spark, d) -> tuple[DataFrame, DataFrame]:
    """Traffic among few hosts and ports, of as many hours as packets, so that flows go both ways; transactions of the same hosts and half year."""
    t = facts.traffic(spark, d)
    flows = t.select(
        (F.col("ip_src") % PARTIES).alias("ip_src"), (F.col("ip_dst") % PARTIES).alias("ip_dst"), "ip_proto", (F.col("port_src") % 2).alias("port_src"),
        (F.col("port_dst") / 100 % 2).cast("int").alias("port_dst"), "start", (F.col("start") + F.col("packets") * HOUR).alias("stop"), "packets", F.col("eth_payload").alias("payload"),
    )
    when, port = (F.col("start") - TX_START) * 6 + START, lambda c: F.col(c).cast("string")
    dns = facts.transactions(spark, d).where("event_id % 3 = 0").withColumns({"rt_avg": F.col("rt"), "request": F.concat("name", F.lit("?")), "response": labels.error(F.col("error"), 0)})
    asked = facts.web(spark, d).where("event_id % 3 = 1")
    asked = asked.withColumns({"request": labels.request(F.col("methd"), F.col("host"), F.col("url"), 60), "response": F.concat(F.lit("status: "), port("status"))})
    opened = facts.tcp(spark, d).where("event_id % 3 = 2")
    opened = opened.withColumns({"request": F.concat(F.lit("SYN "), port("port_clt"), F.lit("→"), port("port_srv")), "response": F.when(F.col("syns") > 2, F.concat(port("syns"), F.lit(" SYNs"))).otherwise("")})
    out = None
    for kind, rows in (("dns", dns), ("web", asked), ("tcp", opened)):
        part = rows.select(
            F.lit(kind).alias("kind"), (F.col("ip_clt") % PARTIES).alias("ip_clt"), (F.col("ip_srv") % PARTIES).alias("ip_srv"), when.alias("start"),
            (when + F.floor(F.col("rt_avg") * 1000)).alias("stop"), "request", "response",
        )
        out = part if out is None else out.unionByName(part)
    return flows, out


def _conversing_sql() -> list[str]:
    when = f"(start - {TX_START}) * 6 + {START}"
    head = f"ip_clt % {PARTIES} AS ip_clt, ip_srv % {PARTIES} AS ip_srv, {when} AS start, {when} + CAST(floor({{}} * 1000) AS BIGINT) AS stop"
    verbs = "['GET', 'HEAD', 'POST', 'CONNECT', 'PUT', 'OPTIONS', 'TRACE', 'DELETE']"
    asked = f"{verbs}[methd + 1] || ' http://' || host || url"
    return [
        f"""f AS MATERIALIZED (SELECT * FROM (SELECT ip_src % {PARTIES} AS ip_src, ip_dst % {PARTIES} AS ip_dst, ip_proto, CAST(port_src % 2 AS INT) AS port_src, CAST(port_dst // 100 % 2 AS INT) AS port_dst,
 start, start + packets * {HOUR} AS stop, packets, eth_payload AS payload FROM traffic) WHERE {INSIDE})""",
        f"""t AS MATERIALIZED (SELECT 'dns' AS kind, {head.format('rt')}, name || '?' AS request, CASE WHEN error = 0 THEN '' ELSE CAST(error AS VARCHAR) END AS response FROM tx WHERE event_id % 3 = 0
 UNION ALL SELECT 'web', {head.format('rt_avg')}, CASE WHEN length({asked}) > 60 THEN left({asked}, 57) || '...' ELSE {asked} END, 'status: ' || status FROM web WHERE event_id % 3 = 1
 UNION ALL SELECT 'tcp', {head.format('rt_avg')}, 'SYN ' || port_clt || '→' || port_srv, CASE WHEN syns > 2 THEN syns || ' SYNs' ELSE '' END FROM tcp WHERE event_id % 3 = 2)""",
    ]


def _portion_sql(v: str) -> str:
    first = f"(CASE WHEN start < w0 THEN {v} * (stop - w0) // greatest(stop - start, 1) ELSE {v} END)"
    return f"CASE WHEN stop > w1 THEN {first} * (w1 - greatest(start, w0)) // greatest(stop - greatest(start, w0), 1) ELSE {first} END"


def _both_ways_sql(hops: int) -> str:
    parts = [*_conversing_sql(), f"r0 AS (SELECT 7::BIGINT AS node, {START}::BIGINT AS t0, {STOP}::BIGINT AS t1)", "v0 AS (SELECT node FROM r0)"]
    shown = []
    keys = "ip_src, ip_dst, ip_proto, port_src, port_dst"
    for k in range(1, hops + 1):
        parts += [
            f"s{k} AS MATERIALIZED (SELECT f.*, t0 AS w0, t1 AS w1 FROM f JOIN r{k - 1} ON ip_src = node AND stop >= t0 AND start < t1)",
            f"c{k} AS MATERIALIZED (SELECT {keys}, w0, w1, min(greatest(start, w0)) AS t0 FROM s{k} GROUP BY ALL)",
            f"""b{k} AS MATERIALIZED (SELECT f.*, w0, w1 FROM f JOIN c{k} c ON f.ip_src = c.ip_dst AND f.ip_dst = c.ip_src AND f.ip_proto = c.ip_proto AND f.port_src = c.port_dst
 AND f.port_dst = c.port_src AND f.stop >= c.t0 AND f.start < w1)""",
            f"""l{k} AS MATERIALIZED (SELECT c.ip_dst AS peer, c.t0, greatest(c.t0, coalesce(last, c.t0)) AS t1 FROM c{k} c LEFT JOIN (SELECT {keys}, max(least(stop, w1)) AS last FROM b{k} GROUP BY ALL) b
 ON b.ip_src = c.ip_dst AND b.ip_dst = c.ip_src AND b.ip_proto = c.ip_proto AND b.port_src = c.port_dst AND b.port_dst = c.port_src)""",
            f"x{k} AS MATERIALIZED (SELECT * FROM t WHERE EXISTS (FROM l{k} WHERE peer = ip_srv AND t.start >= t0 AND t.start < t1))",
            f"r{k} AS MATERIALIZED (SELECT peer AS node, min(t0) AS t0, max(t1) AS t1 FROM l{k} WHERE peer NOT IN (FROM v{k - 1}) GROUP BY 1)",
            f"v{k} AS MATERIALIZED (SELECT node FROM v{k - 1} UNION ALL SELECT node FROM r{k})",
        ]
        shown += [
            f"""SELECT CAST({k} AS INT) AS hop, '{kind}' AS kind, greatest(start, w0) AS start, least(stop, w1) AS stop, {keys}, {_portion_sql('packets')} AS packets, {_portion_sql('payload')} AS payload,
 CAST(NULL AS VARCHAR) AS request, CAST(NULL AS VARCHAR) AS response FROM {table}{k}"""
            for kind, table in (("flow", "s"), ("back", "b"))
        ]
        shown.append(f"SELECT {k}, kind, start, stop, ip_clt, ip_srv, NULL, NULL, NULL, NULL, NULL, request, response FROM x{k}")
    return "+" + ", ".join(parts) + " " + " UNION ALL ".join(shown)


@_query(_both_ways_sql(PARTIES))
def callflow_both_ways(spark, d):
    """What host 7 may have set off in half a year: its flows, those that came back, and what the hosts it reached served meanwhile."""
    flows, transactions = _conversing(spark, d)
    return callflows.callflow(flows, 7, START, STOP, transactions)


# Functions


@_query(f"""SELECT CASE WHEN ip_dst >> 8 = {NET192 >> 8} THEN '192.168.0.0/24' WHEN ip_dst >> 9 = {NET192 >> 9} THEN '192.168.0.0/23'
 ELSE concat_ws('.', (ip_dst >> 24) & 255, (ip_dst >> 16) & 255, (ip_dst >> 8) & 255, ip_dst & 255) END AS subnet, count(*) AS n FROM traffic GROUP BY 1""")
def subnet_blur(spark, d):
    return facts.traffic(spark, d).groupBy(net.blur(F.col("ip_dst"), [(NET192, 24), (NET192, 23)]).alias("subnet")).agg(F.count("*").alias("n"))


@_query(f"SELECT s_suppkey, unnest(range(({TEN8} + s_suppkey * 4) // 4 * 4, ({TEN8} + s_suppkey * 4) // 4 * 4 + 4)) AS ip FROM supplier")
def expand_cidr(spark, d):
    suppliers = spark.read.parquet(f"{d}/supplier.parquet")
    ip = F.lit(TEN8).cast("long") + F.col("s_suppkey") * 4
    return suppliers.select("s_suppkey", F.explode(net.addresses(ip, F.lit(30))).alias("ip"))


@_query("SELECT event_id, start // 60000 * 60000 AS lo, -(-start // 60000) * 60000 + CASE WHEN start % 60000 > 0 THEN 60000 ELSE 0 END AS hi FROM tx")
def round_ts(spark, d):
    return facts.transactions(spark, d).select("event_id", times.floor_to(F.col("start"), 60_000).alias("lo"), times.ceil_to(F.col("start"), 60_000).alias("hi"))


@_query(f"""SELECT start // {WEEK} * {WEEK} AS a, CASE WHEN (stop + {WEEK} - 1) // {WEEK} * {WEEK} = start // {WEEK} * {WEEK} THEN start // {WEEK} * {WEEK} + {WEEK}
 ELSE (stop + {WEEK} - 1) // {WEEK} * {WEEK} END AS b, count(*) AS n FROM traffic GROUP BY 1, 2""")
def round_interval(spark, d):
    a, b = times.round_interval(F.col("start"), F.col("stop"), WEEK)
    return facts.traffic(spark, d).groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"))


@_query("""SELECT eth_proto, ip_proto, port_dst, CASE eth_proto WHEN 2048 THEN 'IPv4' WHEN 2054 THEN 'ARP' END AS proto,
 CASE ip_proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' ELSE 'icmp' END || '/' || CASE port_dst WHEN 100 THEN 'newacct' ELSE CAST(port_dst AS VARCHAR) END AS app, count(*) AS n FROM traffic GROUP BY ALL""")
def labels_proto(spark, d):
    rows = facts.traffic(spark, d).groupBy("eth_proto", "ip_proto", "port_dst").agg(F.count("*").alias("n"))
    return rows.withColumns({"proto": labels.eth_proto(F.col("eth_proto")), "app": labels.app_key(F.col("ip_proto"), F.col("port_dst"))})


@_query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'GET' WHEN 1 THEN 'HEAD' WHEN 2 THEN 'POST' WHEN 3 THEN 'CONNECT' WHEN 4 THEN 'PUT' WHEN 5 THEN 'OPTIONS' WHEN 6 THEN 'TRACE' ELSE 'DELETE' END || ' http://h/' || name AS request,
 CASE WHEN error = 0 THEN '' ELSE CAST(error AS VARCHAR) END AS err, 'h' || CASE WHEN event_id % 3 = 0 THEN '' ELSE ':' || CAST(80 + event_id % 3 AS VARCHAR) END || '/' || name AS url FROM tx""")
def labels_request(spark, d):
    t = facts.transactions(spark, d)
    path, port = F.concat(F.lit("/"), "name"), (80 + F.col("event_id") % 3)
    return t.select(
        "event_id", labels.request((F.col("event_id") % 8).cast("int"), F.lit("h"), path, 60).alias("request"),
        labels.error(F.col("error"), 0).alias("err"), labels.url_name(F.lit("h"), port, path).alias("url"),
    )


@_query("""SELECT l_quantity AS q, CASE WHEN l_quantity * 100 >= 1000 THEN regexp_replace(printf('%.3f', l_quantity / 10), '\\.?0+$', '') || 'k' ELSE CAST(CAST(l_quantity * 100 AS BIGINT) AS VARCHAR) END AS text, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def format_number(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").alias("q"))
    return lines.groupBy("q", numbers.number(F.col("q") * 100).alias("text")).agg(F.count("*").alias("n"))


@_query("SELECT start, strftime(make_timestamp(start * 1000), '%Y-%m-%d %H:%M') || CASE WHEN start % 1000 <> 0 THEN strftime(make_timestamp(start * 1000), ':%S.%g') WHEN start % 60000 <> 0 THEN strftime(make_timestamp(start * 1000), ':%S') ELSE '' END AS text FROM tx")
def format_time(spark, d):
    return facts.transactions(spark, d).select("start", times.format_millis(F.col("start")).alias("text"))


# Rollups and storage

_KEYS = ["ip_src", "ip_proto", "vlan"]


def _rollup_sql(step: int) -> str:
    return f"""SELECT ip_src, ip_proto, vlan, start // {step} * {step} AS start, CASE WHEN (stop + {step} - 1) // {step} * {step} = start // {step} * {step} THEN start // {step} * {step} + {step}
 ELSE (stop + {step} - 1) // {step} * {step} END AS stop, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(eth_payload) AS BIGINT) AS eth_payload, max(mtu) AS mtu FROM traffic GROUP BY 1, 2, 3, 4, 5"""


@_query(_rollup_sql(86_400_000))
def lod1_rollup(spark, d):
    return rollups.traffic_rollup(facts.traffic(spark, d), _KEYS, 86_400_000)


@_query(_rollup_sql(WEEK))
def lod2_from_lod1(spark, d):
    return rollups.traffic_rollup(rollups.traffic_rollup(facts.traffic(spark, d), _KEYS, 86_400_000), _KEYS, WEEK)


@_query(f"SELECT ip_srv, name, start // {HOUR} * {HOUR} AS start, {_DIST} FROM tx GROUP BY 1, 2, 3")
def transaction_rollup(spark, d):
    rt = F.col("rt")
    one = F.struct(F.lit(1).cast("long").alias("count"), rt.alias("min"), rt.alias("max"), rt.alias("avg"), F.lit(0.0).alias("m2"))
    minutes = rollups.transaction_rollup(facts.transactions(spark, d).withColumn("rt", one), ["ip_srv", "name"], 60_000)
    return _flat(rollups.transaction_rollup(minutes, ["ip_srv", "name"], HOUR), "ip_srv", "name", "start")


def _whole(rows: DataFrame) -> DataFrame:
    """Response times of single transactions as distributions."""
    return rows.withColumn("rt", F.struct(*[F.col(f"rt_{c}").alias(c) for c in ("count", "min", "max", "avg", "m2")]))


_SUBNETS = [(NET192 + 512, 25), (NET192 + 512, 23), (NET192, 24)]
_BLUR = f"CASE WHEN ip_clt >> 7 = {NET192 + 512 >> 7} THEN 25 WHEN ip_clt >> 9 = {NET192 + 512 >> 9} THEN 23 WHEN ip_clt >> 8 = {NET192 >> 8} THEN 24 ELSE 32 END"


@_query(f"""+b AS (SELECT *, ip_clt >> (32 - m) << (32 - m) AS net FROM (SELECT *, {_BLUR} AS m FROM web))
SELECT net AS ip_clt, m AS mask_clt, status, start // {HOUR} * {HOUR} AS start, count(*) AS n, round(avg(rt_avg), 12) AS av FROM b
 WHERE m >= 26 AND net >> 6 = {NET192 + 640 >> 6} OR m < 26 AND net >> (32 - m) = {NET192 + 640} >> (32 - m) GROUP BY 1, 2, 3, 4""")
def client_subnet(spark, d):
    """Rows of a rollup by client subnet that share an address with a subnet asked for."""
    hours = rollups.transaction_rollup(_whole(facts.web(spark, d)), ["ip_clt", "ip_srv", "status"], HOUR, subnets=_SUBNETS)
    rows = presets.transactions(hours, client=(NET192 + 640, 26))
    out = aggregates.merge_distributions(rows, ["ip_clt", "mask_clt", "status", "start"], "rt")
    return out.select("ip_clt", "mask_clt", "status", "start", F.col("rt.count").alias("n"), F.round("rt.avg", 12).alias("av"))


@_query(f"""+f AS (SELECT ip_srv, port_srv, start // {HOUR} * {HOUR} AS start, ip_clt >> (32 - m) << (32 - m) AS ip_clt, m AS mask_clt, syns, rt_avg FROM (SELECT *, {_BLUR} AS m FROM tcp))
SELECT ip_srv, port_srv, ip_clt, mask_clt, start, CAST(sum(syns) AS BIGINT) AS syns, count(*) AS n, round(max(rt_avg), 12) AS hi FROM f GROUP BY ALL""")
def tcp_rollup(spark, d):
    """Sockets by hour with client ports cleared, clients as subnets and SYNs summed."""
    keys = ["ip_srv", "port_srv", "ip_clt", "port_clt"]
    hours = rollups.transaction_rollup(_whole(facts.tcp(spark, d)), keys, HOUR, subnets=_SUBNETS, sums=("syns",))
    return hours.where("port_clt = 0").select("ip_srv", "port_srv", "ip_clt", "mask_clt", "start", "syns", F.col("rt.count").alias("n"), F.round("rt.max", 12).alias("hi"))


_WEB = f"start >= {TX_START} AND start < {TX_STOP} AND status = 200 AND methd = 4 AND suffix(host, '.example') AND starts_with(url, '/c') AND rt_avg >= 0.001 AND rt_avg <= 0.4"


def _web(spark, d) -> DataFrame:
    return presets.transactions(
        facts.web(spark, d), start=TX_START, stop=TX_STOP, status=200, methd=4, host=".example", url="/c", rt_min=0.001, rt_max=0.4, tx_min=1, server="10.0.0.0/8", client=(NET192, 16)
    )


@_query(f"SELECT event_id, ip_srv, host, url, rt_avg FROM web WHERE {_WEB} ORDER BY rt_avg DESC, event_id LIMIT 25")
def web_top_requests(spark, d):
    return top.top_rows(_web(spark, d), "rt_avg", 25, True, "event_id").select("event_id", "ip_srv", "host", "url", "rt_avg")


@_query(f"""+b AS (SELECT (start - {TX_START}) // {HOUR} AS row, count(*) AS count, min(rt_avg) AS lo, max(rt_avg) AS hi FROM web WHERE {_WEB} GROUP BY 1)
SELECT r AS row, coalesce(count, 0) AS count, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi FROM range({_ROWS}) t(r) LEFT JOIN b ON b.row = r""")
def web_resp_time(spark, d):
    out = series.per_date(_web(spark, d), "rt_avg", TX_START, TX_STOP, HOUR)
    return out.select("row", "count", F.col("min").alias("lo"), F.col("max").alias("hi"))


@_query(f"SELECT ip_srv, CAST(floor(rt_avg / 0.02) AS BIGINT) AS bucket, count(*) AS n FROM web WHERE {_WEB} GROUP BY 1, 2")
def web_distribution(spark, d):
    return series.histogram(_web(spark, d), "ip_srv", "rt_avg", 0.02)


_SIX = "CASE WHEN event_id % 3 = 0 THEN '2001:db8:' || lower(to_hex(user_id)) || '::' || lower(to_hex(event_id)) ELSE concat_ws('.', 10, event_id % 4, user_id % 256, event_id % 256) END"


@_query(f"""SELECT CASE WHEN event_id % 3 = 0 THEN CASE WHEN user_id // 16 = 1 THEN '2001:db8:10::' WHEN user_id = 5 THEN '2001:db8:5::' ELSE '2001:db8::' END
 WHEN event_id % 4 = 1 AND user_id % 256 < 16 THEN '10.1.0.0' WHEN event_id % 4 < 2 THEN '10.0.0.0' ELSE {_SIX} END AS net,
 CASE WHEN event_id % 3 = 0 THEN CASE WHEN user_id // 16 = 1 THEN 44 WHEN user_id = 5 THEN 48 ELSE 32 END
 WHEN event_id % 4 = 1 AND user_id % 256 < 16 THEN 20 WHEN event_id % 4 < 2 THEN 15 ELSE 32 END AS mask, count(*) AS n FROM events GROUP BY 1, 2""")
def subnets_both_families(spark, d):
    """Addresses of both families by the first configured subnet that holds them."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id")
    group = lambda c, at: F.lower(F.hex(F.shiftright(c, at).bitwiseAND(F.lit(0xFFFF))))
    user, event = F.coalesce("user_id", F.lit(-1)).cast("long"), F.col("event_id").cast("long")
    # a group has four digits: users beyond them share the last one's network, and hosts in it have the whole numbers
    network = F.when(user.between(0, 0xFFFF), user).otherwise(0xFFFF)
    six = F.concat_ws(":", F.lit("2001:db8"), group(network, 0), *[group(user, at) for at in (16, 0)], *[group(event, at) for at in (32, 16, 0)])
    four = F.concat_ws(".", F.lit("10"), *[x.cast("string") for x in (F.col("event_id") % 4, F.col("user_id") % 256, F.col("event_id") % 256)])
    text = F.when(F.col("event_id") % 3 == 0, six).otherwise(four)
    known = addresses.subnet_table(spark, ["10.1.0.0/20", "2001:db8:10::/44", "2001:db8:5::/48", "2001:db8::/32", "10.0.0.0/15", "2001:db8:5::/64", "10.1.9.0/24"])
    out = addresses.subnet_of(rows.select(addresses.parse(text).alias("ip")), "ip", known)
    return out.groupBy(addresses.display(F.col("net")).alias("net"), "mask").agg(F.count("*").alias("n"))


@_query("SELECT ip_clt, ip_srv, port_srv, methd, status, start, rt_avg, host, url, 'eth0' AS iface FROM web")
def text_round_trip(spark, d):
    """Web rows written as text lines and read back with every line checked."""
    rows = facts.web(spark, d).withColumns({
        "origin": F.struct(F.lit("iface").alias("kind"), F.lit("eth0").alias("name")), "mac_clt": F.lit("02:00:00:00:00:01"), "mac_srv": F.lit("02:00:00:00:00:02"),
    })
    path = _table(rows, "web-text", lambda r, to: facts.dump_text(r, to, "web"))
    good, _ = facts.load_lines(spark, "web", path)
    return good.select("ip_clt", "ip_srv", "port_srv", "methd", "status", "start", "rt_avg", "host", "url", F.col("origin.name").alias("iface"))


def _table(rows: DataFrame, name: str, write) -> str:
    """Path of a new table of ``rows`` in the shared folder."""
    path = f"{staging.shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    write(rows, path)
    return path


def _name_levels(spark, d) -> str:
    """Levels of the events as name-server transactions."""
    rt = F.col("rt")
    one = F.struct(F.lit(1).cast("long").alias("count"), rt.alias("min"), rt.alias("max"), rt.alias("avg"), F.lit(0.0).alias("m2"))
    rows = facts.transactions(spark, d).select("ip_srv", "name", "start", one.alias("rt"))
    return _table(rows, "dns-levels", lambda r, path: levels.write_levels(r, path, "dns", ["ip_srv", "name"], "ip_srv", buckets=13))


@_query(f"SELECT '1hour' AS level, start // {HOUR} * {HOUR} AS start, count(*) AS n FROM tx GROUP BY 2")
def choose_lod(spark, d):
    """A series by two hours' steps is read from the table of hours."""
    level = rollups.level_for("dns", 2 * HOUR)
    rows = facts.read_table(spark, f"{_name_levels(spark, d)}/dns/{level}", ip="ip_srv", buckets=13)
    return rows.groupBy(F.lit(level).alias("level"), "start").agg(F.sum("rt.count").alias("n"))


_ODD = (TX_START + 5 * HOUR + 123_457, TX_STOP - 7 * HOUR - 77_777)


@_query(f"SELECT ip_srv, {_DIST.replace(', 6)', ', 12)').replace(', 4)', ', 9)')} FROM tx WHERE start >= {_ODD[0]} AND start < {_ODD[1]} AND ip_srv >> 6 = {TEN8 >> 6} GROUP BY 1")
def levels_name_range(spark, d):
    """A range that no hour bounds: hours inside, minutes and single rows at its edges."""
    rows = levels.read_levels(spark, _name_levels(spark, d), "dns", *_ODD, ["ip_srv", "name", "rt"], cidr=(TEN8, 26), ip="ip_srv", buckets=13)
    return _flat(aggregates.merge_distributions(rows, ["ip_srv"], "rt"), "ip_srv", digits=12)


@_query(f"""SELECT ip_proto, start // {HOUR} AS h, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(eth_payload) AS BIGINT) AS eth_payload, max(mtu) AS mtu FROM traffic
 WHERE start >= {START} AND start < {STOP} AND ip_src BETWEEN {TEN8 + 8} AND {TEN8 + 11} GROUP BY 1, 2""")
def levels_traffic_range(spark, d):
    """Half a year of a subnet's traffic by hours, from the tables of minutes, ten minutes and hours."""
    keys = ["ip_src", "ip_proto", "vlan"]
    root = _table(facts.traffic(spark, d), "traffic-levels", lambda r, path: levels.write_levels(r, path, "traffic", keys, "ip_src", buckets=13))
    rows = levels.read_levels(spark, root, "traffic", START, STOP, [*keys, "start", "packets", "eth_payload", "mtu"], wanted=HOUR, cidr=(TEN8 + 8, 30), buckets=13)
    sums = [F.sum(c).cast("long").alias(c) for c in ("packets", "eth_payload")]
    return rows.groupBy("ip_proto", times.div(F.col("start"), HOUR).alias("h")).agg(*sums, F.max("mtu").alias("mtu"))


def _buckets(spark, d) -> str:
    return _table(facts.traffic(spark, d), "traffic", lambda r, path: facts.write_table(r, path, "ip_src", buckets=13))


@_query(f"SELECT start, stop, packets FROM traffic WHERE start >= {START} AND start < {START + WEEK}")
def zone_prune(spark, d):
    """A week out of a stored table, whose row groups are skipped by time."""
    return facts.read_table(spark, _buckets(spark, d), buckets=13, begins=(START, START + WEEK)).select("start", "stop", "packets")


@_query(f"SELECT CAST(ip_src % 13 AS INT) AS ip_bucket, ip_src, count(*) AS n FROM traffic WHERE ip_src BETWEEN {TEN8 + 4} AND {TEN8 + 7} GROUP BY 1, 2")
def bucket_prune(spark, d):
    """A small subnet out of a stored table, of which only its buckets are read."""
    return facts.read_table(spark, _buckets(spark, d), cidr=(TEN8 + 4, 30), buckets=13).groupBy("ip_bucket", "ip_src").agg(F.count("*").alias("n"))


_HALF_YEAR, _RETAINED_AT, _MAX_AGE = 26 * WEEK, 915_148_800_000, 6 * 31_536_000_000


@_query(f"""+slices AS (SELECT start // {_HALF_YEAR} AS slice, count(*) AS n, CAST(sum(eth_payload) AS BIGINT) AS eth_payload, max(stop) AS last FROM traffic GROUP BY 1),
 sized AS (SELECT *, sum(n) OVER newest AS newer, row_number() OVER newest AS place, sum(n) OVER () AS total FROM slices WINDOW newest AS (ORDER BY last DESC, slice DESC))
 SELECT slice, n, eth_payload FROM sized WHERE place = 1 OR ({_RETAINED_AT} - last <= {_MAX_AGE} AND newer <= total // 2)""")
def retention_by_size(spark, d):
    """What a stored table holds after two appends, compaction and a purge by age and by half of its rows."""
    path = f"{staging.shared_dir(spark)}/retained-{uuid.uuid4().hex}"
    rows = staging.staged(facts.traffic(spark, d).select("start", "stop", "ip_src", "ip_proto", "eth_payload"), "traffic")
    for part in ("ip_proto = 6", "ip_proto <> 6"):
        segments.append(rows.where(part), path, "ip_src", slice_ms=_HALF_YEAR, buckets=3)
    segments.compact(spark, path)
    total = segments.segments(spark, path).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    segments.purge(spark, path, _RETAINED_AT, segments.Retention(max_age=_MAX_AGE, max_rows=total // 2))
    segments.vacuum(spark, path)
    kept = segments.read(spark, path, buckets=3)
    return kept.groupBy(times.div(F.col("start"), _HALF_YEAR).alias("slice")).agg(F.count("*").alias("n"), F.sum("eth_payload").cast("long").alias("eth_payload"))


@_query("SELECT 'traffic' AS kind, ip_src AS ip, start FROM traffic WHERE ip_proto = 1 UNION ALL SELECT 'dns', ip_srv, start FROM tx")
def union_transactions(spark, d):
    flows = presets.traffic(facts.traffic(spark, d), ip_proto=1).select(F.lit("traffic").alias("kind"), F.col("ip_src").alias("ip"), "start")
    return flows.unionByName(facts.transactions(spark, d).select(F.lit("dns").alias("kind"), F.col("ip_srv").alias("ip"), "start"))


@_query("""SELECT q.event_id AS query_id, a.event_id AS answer_id, a.ms - q.ms AS wait FROM (SELECT event_id, user_id, ts, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type = 'view') q
 ASOF JOIN (SELECT min(event_id) AS event_id, user_id, ts, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type = 'click' GROUP BY ALL) a ON q.user_id = a.user_id AND a.ts >= q.ts
 WHERE a.ts - q.ts <= INTERVAL 1 HOUR""")
def http_match_join(spark, d):
    """Each query (view) with its first answer (click) of the same user within an hour."""
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("n"), "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    views, clicks = rows.where("event_type = 'view'"), rows.where("event_type = 'click'").withColumnsRenamed({"ts": "at", "n": "answer"})
    out = packets.first_answers(views, rows.where("event_type = 'click'"), ["user_id"], HOUR)
    found = out.join(clicks.select(F.col("answer").alias("a_n"), "at"), "a_n")
    return found.select(F.col("q_n").alias("query_id"), F.col("a_n").alias("answer_id"), (F.unix_millis("at") - F.unix_millis("ts")).alias("wait"))


@_query("""SELECT query_id, CASE WHEN near THEN answer_id END AS answer_id, ip_clt, CASE WHEN near THEN wait / 1e6 ELSE 0 END AS rt, NOT near AS timed_out FROM
 (SELECT q.n AS query_id, a.n AS answer_id, q.ip_src AS ip_clt, a.us - q.us AS wait, coalesce(a.us - q.us <= 10000000, false) AS near FROM (SELECT * FROM packets WHERE up) q
 ASOF LEFT JOIN (SELECT min(n) AS n, ip_src, ip_dst, us FROM packets WHERE NOT up GROUP BY ALL) a ON q.ip_src = a.ip_dst AND q.ip_dst = a.ip_src AND a.us >= q.us)""")
def dns_first_answer(spark, d):
    """Packets to a server as queries, those back as answers: first answers within ten seconds, and queries without."""
    rows, up = facts.packets(spark, d), F.col("n") % 3 != 0
    queries = rows.where(up).withColumnsRenamed({"ip_src": "ip_clt", "ip_dst": "ip_srv"})
    answers = rows.where(~up).withColumnsRenamed({"ip_dst": "ip_clt", "ip_src": "ip_srv"})
    out = packets.first_answers(queries, answers, ["ip_clt", "ip_srv"], packets.DNS_TIMEOUT, keep_unanswered=True)
    return out.select(F.col("q_n").alias("query_id"), F.col("a_n").alias("answer_id"), "ip_clt", "rt", "timed_out")


@_query(f"""+p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY us, n) AS k FROM packets WHERE ip_src IS NOT NULL),
r AS (WITH RECURSIVE r AS (SELECT pair, 0::BIGINT AS k, NULL::BOOLEAN AS c, NULL::BIGINT AS s, 0::BIGINT AS syns, [NULL::STRUCT(c BOOLEAN, s BIGINT, syns BIGINT, ct DOUBLE, late BOOLEAN)] AS done FROM (SELECT DISTINCT pair FROM p)
 UNION ALL SELECT pair, k, CASE WHEN opens THEN NULL WHEN syn THEN coalesce(c, up) ELSE c END, CASE WHEN opens THEN NULL WHEN syn THEN coalesce(s, us) ELSE s END,
 CASE WHEN opens THEN 0 WHEN syn THEN syns + 1 ELSE syns END, [CASE WHEN expired THEN struct_pack(c := c0, s := s0, syns := n0, ct := 0.0::DOUBLE, late := true) END,
 CASE WHEN opens THEN struct_pack(c := c0, s := s0, syns := n0, ct := (us - s0) / 1e6, late := false) END] FROM (SELECT *, s IS NOT NULL AND ack AND up = c AS opens FROM
 (SELECT r.pair, p.k, p.us, p.syn, p.ack, p.up, r.c AS c0, r.s AS s0, r.syns AS n0, r.s IS NOT NULL AND p.us > r.s + 80000000 AS expired,
 CASE WHEN p.us > r.s + 80000000 THEN NULL ELSE r.c END AS c, CASE WHEN p.us > r.s + 80000000 THEN NULL ELSE r.s END AS s, CASE WHEN p.us > r.s + 80000000 THEN 0 ELSE r.syns END AS syns
 FROM r JOIN p ON p.pair = r.pair AND p.k = r.k + 1))) FROM r),
o AS (SELECT pair, d FROM (SELECT pair, unnest(done) AS d FROM r) WHERE d IS NOT NULL
 UNION ALL SELECT pair, struct_pack(c := c, s := s, syns := syns, ct := 0.0::DOUBLE, late := true) FROM r WHERE s IS NOT NULL AND k = (SELECT max(k) FROM p WHERE p.pair = r.pair))
SELECT CASE WHEN d.c THEN {TEN8} + pair ELSE {NET192} + pair % 5 END AS ip_clt, CASE WHEN d.c THEN 1024 + pair ELSE 443 END AS port_clt, CASE WHEN d.c THEN {NET192} + pair % 5 ELSE {TEN8} + pair END AS ip_srv,
 CASE WHEN d.c THEN 443 ELSE 1024 + pair END AS port_srv, d.s AS us, d.syns AS syns, d.ct AS ct, d.late AS timed_out FROM o""")
def socket_openings(spark, d):
    out = packets.sockets(facts.packets(spark, d).where("ip_src IS NOT NULL"))
    port = lambda c: F.col(c).cast("long").alias(c)
    return out.select("ip_clt", port("port_clt"), "ip_srv", port("port_srv"), F.unix_micros("ts").alias("us"), "syns", "ct", "timed_out")


@_query("""+p AS (SELECT *, CASE WHEN lag(up) OVER w = up AND us - lag(us) OVER w <= 500000 THEN 0 ELSE 1 END AS new FROM packets WHERE payload > 0 AND ip_src IS NOT NULL WINDOW w AS (PARTITION BY pair ORDER BY us, n)),
s AS (SELECT *, sum(new) OVER (PARTITION BY pair ORDER BY us, n) AS f FROM p)
SELECT ip_proto, ip_src, port_src, ip_dst, port_dst, min(us) AS start, max(us) AS stop, count(*) AS packets, CAST(sum(payload) AS BIGINT) AS payload FROM s GROUP BY pair, f, ALL""".replace(", ALL", ", ip_proto, ip_src, port_src, ip_dst, port_dst"))
def flow_sessions(spark, d):
    out = packets.flows(facts.packets(spark, d).where("ip_src IS NOT NULL"))
    return out.withColumns({"start": F.unix_micros("start"), "stop": F.unix_micros("stop")})


@_query("""+p AS MATERIALIZED (SELECT mac_src, mac_dst, eth_proto, ip_src, ip_dst, ip_proto, CASE WHEN ip_proto IN (6, 17) THEN port_src END AS port_src, CASE WHEN ip_proto IN (6, 17) THEN port_dst END AS port_dst,
 us, eth_payload, CASE WHEN ip_src IS NULL THEN 0 ELSE ip_payload END AS ip_payload, CASE WHEN ip_proto IN (6, 17) THEN l4_payload ELSE 0 END AS l4_payload, pair, up,
 row_number() OVER (PARTITION BY pair, up ORDER BY us, n) AS k FROM packets),
r AS (WITH RECURSIVE r AS (SELECT pair, up, k, us, us AS first FROM p WHERE k = 1
 UNION ALL SELECT p.pair, p.up, p.k, p.us, CASE WHEN p.us - r.first <= 60000000 THEN r.first ELSE p.us END FROM r JOIN p ON p.pair = r.pair AND p.up = r.up AND p.k = r.k + 1) FROM r)
SELECT mac_src, mac_dst, eth_proto, ip_src, ip_dst, ip_proto, port_src, port_dst, r.first AS start, max(p.us) AS stop, count(*) AS packets, CAST(sum(eth_payload) AS BIGINT) AS eth_payload,
 max(eth_payload) AS mtu, CAST(sum(ip_payload) AS BIGINT) AS ip_payload, CAST(sum(l4_payload) AS BIGINT) AS l4_payload FROM p JOIN r USING (pair, up, k)
 GROUP BY mac_src, mac_dst, eth_proto, ip_src, ip_dst, ip_proto, port_src, port_dst, r.first""")
def traffic_sessions(spark, d):
    out = packets.traffic(facts.packets(spark, d))
    return out.withColumns({"start": F.unix_micros("start"), "stop": F.unix_micros("stop")})


@_query("""SELECT user_id, min(ms) AS start, max(ms) + 3600000 AS stop, count(*) AS packets FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
 (SELECT event_id, user_id, ts, epoch_us(ts) // 1000 AS ms, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def session_gap(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    out = rows.groupBy(F.session_window("ts", "1 hour"), "user_id").agg(F.count("*").alias("packets"))
    return out.select("user_id", times.millis("session_window.start").alias("start"), times.millis("session_window.end").alias("stop"), "packets")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql is not None}
