"""Fact tables: schemas, text files, bucketed Parquet tables, and the driver's tables seen as facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlens.functions import addresses, net, times

_DISTRIBUTION = "rt_count long, rt_min double, rt_max double, rt_avg double, rt_m2 double"
#: Columns of the five fact tables, in the order of their text form.
SCHEMAS = {
    "traffic": "origin string, start string, stop string, packets long, vlan string, mac_src string, mac_dst string, eth_proto int, eth_payload long, "
    "mtu int, ip_src string, ip_dst string, ip_proto int, ip_payload long, port_src int, port_dst int, l4_payload long",
    "flow": "origin string, vlan string, mac_src string, ip_src string, mac_dst string, ip_dst string, ip_proto int, port_src int, port_dst int, "
    "start string, stop string, packets long, l4_payload long",
    "tcp": "origin string, vlan string, mac_clt string, ip_clt string, mac_srv string, ip_srv string, port_clt int, port_srv int, start string, "
    f"syns long, {_DISTRIBUTION}",
    "dns": f"origin string, vlan string, mac_clt string, ip_clt string, mac_srv string, ip_srv string, error int, start string, {_DISTRIBUTION}, name string",
    "web": "origin string, vlan string, mac_clt string, ip_clt string, mac_srv string, ip_srv string, port_srv int, methd int, status int, "
    f"start string, {_DISTRIBUTION}, host string, url string",
}
BUCKETS = 1009


_ADDRESSES = ("ip_src", "ip_dst", "ip_clt", "ip_srv")


class BadLine(ValueError):
    """A line of a text file that is no row of its metric."""


def load_text(spark: SparkSession, metric: str, path: str, streaming: bool = False) -> DataFrame:
    """Tab-separated rows of a metric; a line that doesn't parse fails the load. ``load_lines`` says which."""
    reader = (spark.readStream if streaming else spark.read).schema(SCHEMAS[metric]).option("sep", "\t").option("mode", "FAILFAST")
    return typed(reader.csv(path))


def load_lines(spark: SparkSession, metric: str, path: str, wide: bool = False, stop: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows of a metric's text files, and the lines that are none: (file, line, text, fields).

    A line is bad if it has too few or too many fields or one that doesn't parse; ``fields`` names these (empty: their number). With ``stop`` the first
    bad line of the first file raises ``BadLine``, else bad lines are left to the caller, as a side table. ``wide`` reads addresses of both
    families. Lines are parsed where they lie; only for files with bad lines, and only if these are asked for, are the lines of each split counted, which
    gives a line its number however the file was split. Empty files and empty lines at the end have no rows.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")
    )
    forms = [x.split() for x in SCHEMAS[metric].split(", ")]
    field = lambda i: F.nullif(F.get("_f", F.lit(i)), F.lit(""))
    text = lines.select("*", F.split("value", "\t", -1).alias("_f"))
    rows = typed(text.select("*", *[field(i).try_cast(kind).alias(name) for i, (name, kind) in enumerate(forms)]), wide)

    def wrong(i: int, name: str) -> Column:
        """A field that has no value though it must: empty only where a text may be, null only where it says so."""
        given = field(i)
        excused = given.isNull() if name in _TEXTS else given == "None" if name == "vlan" else F.lit(False)
        return F.when(F.col(name).isNull() & ~F.coalesce(excused, F.lit(False)), F.lit(name))

    names = [x[0] for x in forms]
    faults = F.when(F.size("_f") == len(names), F.array_compact(F.array(*[wrong(i, c) for i, c in enumerate(names)])))
    checked = rows.withColumn("_wrong", F.coalesce(faults, F.array(F.lit(None).cast("string"))))  # one null: the number of fields
    checked = checked.withColumn("_bad", F.size("_wrong") > 0)
    own = [c for c in rows.columns if not c.startswith("_") and c not in ("value", "file")]
    bad = _numbered(checked.where("_bad").select("file", "_block", "_id", F.col("value").alias("text"), F.array_compact("_wrong").alias("fields")), lines)
    if stop:
        if checked.where("_bad").count():  # only then lines are numbered, which shuffles those of whole files
            first = bad.orderBy("file", "line").first()
            raise BadLine(f"{first.file}:{first.line}: {', '.join(first.fields) or 'number of fields'}: {first.text!r}")
        return rows.select(*own), bad
    return checked.where("NOT _bad").select(*own), bad


#: Columns that may be empty.
_TEXTS = ("name", "host", "url")


def _numbered(bad: DataFrame, lines: DataFrame) -> DataFrame:
    """Bad lines with the number each has in its file: its place in its split after the lines of the splits before."""
    task = F.shiftright("_id", 33)
    of_files = lines.join(bad.select("file").distinct(), "file", "left_semi")
    splits = of_files.groupBy("file", "_block", task.alias("_task")).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("file", "_block", "_first", "_before")
    return bad.join(splits, ["file", "_block"]).select("file", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line"), "text", "fields")


def typed(rows: DataFrame, wide: bool = False) -> DataFrame:
    """Text forms as numbers: times in milliseconds, addresses as bigint (``wide``: of both families), ``None`` and ``Some n`` as a nullable int.

    Clients that are subnets (``net/mask``) keep their mask in ``mask_clt``.
    """
    changes: dict[str, Column] = {}
    for c in rows.columns:
        if c in ("start", "stop"):
            changes[c] = times.parse_sniffed(F.col(c))
        elif c == "vlan":
            changes[c] = F.regexp_extract("vlan", r"^Some (-?\d+)$", 1).try_cast("int")
        elif c in _ADDRESSES:
            host = F.substring_index(c, "/", 1)
            changes[c] = addresses.parse(host) if wide else net.parse_ip(host)
            if c == "ip_clt":
                changes["mask_clt"] = F.when(F.col(c).contains("/"), F.substring_index(c, "/", -1).try_cast("int")).otherwise(F.when(F.col(c).contains(":"), 128).otherwise(32))
        elif c.startswith("mac_"):
            changes[c] = net.mac(F.col(c))
    if "origin" in rows.columns:
        changes["origin"] = F.struct(F.substring_index("origin", " ", 1).alias("kind"), F.regexp_replace("origin", r"^\S+ ", "").alias("name"))
    return rows.withColumns(changes)


def written(rows: DataFrame, metric: str) -> DataFrame:
    """Rows of a metric in their text forms, the columns in their order: what ``typed`` undoes."""
    out = []
    for c in (x.split()[0] for x in SCHEMAS[metric].split(", ")):
        x = F.col(c)
        if c in ("start", "stop"):
            out.append(F.concat(times.div(x, 1000).cast("string"), F.lit("s "), (F.pmod(x, F.lit(1000)) * 1000).cast("string"), F.lit("us")).alias(c))
        elif c == "vlan":
            out.append(F.coalesce(F.concat(F.lit("Some "), x.cast("string")), F.lit("None")).alias(c))
        elif c in _ADDRESSES:
            text = net.format_ip(x) if rows.schema[c].dataType.simpleString() == "bigint" else addresses.display(x)
            if c == "ip_clt" and "mask_clt" in rows.columns:
                whole = F.when(text.contains(":"), 128).otherwise(32)
                text = F.when(F.col("mask_clt") < whole, F.concat(text, F.lit("/"), F.col("mask_clt").cast("string"))).otherwise(text)
            out.append(text.alias(c))
        elif c == "origin":
            out.append(F.concat_ws(" ", "origin.kind", "origin.name").alias(c))
        else:
            out.append(x.cast("string").alias(c))
    return rows.select(*out)


def dump_text(rows: DataFrame, path: str, metric: str = "traffic") -> None:
    """Tab-separated text of a metric's rows, as ``load_text`` and ``load_lines`` read it."""
    shown = written(rows, metric)
    line = F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) for c in shown.columns])
    shown.select(line.alias("value")).write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str, ip: str, ts: str = "start", buckets: int = BUCKETS) -> None:
    """Append to a table laid out by hash bucket of ``ip`` and, within files, by time, whose Parquet statistics are the zone map.

    Tasks write ranges of (bucket, time), so a bucket with many rows is many files, each of a span of time.
    """
    out = rows.withColumn("ip_bucket", net.bucket(F.col(ip), buckets))
    write_dealt(out.repartitionByRange("ip_bucket", ts), path, ts)


def write_dealt(rows: DataFrame, path: str, ts: str = "start") -> None:
    """As ``write_table`` for rows with their ``ip_bucket`` that tasks hold by ranges of (bucket, time)."""
    rows.sortWithinPartitions("ip_bucket", ts).write.partitionBy("ip_bucket").mode("append").parquet(path)


def read_table(
    spark: SparkSession, path: str, start: int | None = None, stop: int | None = None, cidr: tuple[int, int] | None = None,
    ip: str = "ip_src", start_column: str = "start", stop_column: str = "stop", buckets: int = BUCKETS, begins: tuple[int, int] | None = None,
) -> DataFrame:
    """Rows that overlap [start, stop[, or begin in [begins[, with ``ip`` in ``cidr``; a subnet smaller than the buckets prunes partitions.

    Times and addresses are compared as stored, so the scan gets them as pushed filters and skips row groups by their statistics.
    """
    out = pruned(spark.read.parquet(path), start, stop, cidr, ip, start_column, stop_column, buckets)
    if begins is not None:
        out = out.where((F.col(start_column) >= begins[0]) & (F.col(start_column) < begins[1]))
    return out


def pruned(out: DataFrame, start: int | None, stop: int | None, cidr: tuple[int, int] | None, ip: str, start_column: str, stop_column: str, buckets: int) -> DataFrame:
    """Filters that a scan of a bucketed table takes as its own."""
    if cidr is not None:
        net_, mask = cidr
        size = 1 << (32 - mask)
        low = net_ // size * size
        if size < buckets:
            out = out.where(F.col("ip_bucket").isin(sorted({(low + i) % buckets for i in range(size)})))
        out = out.where(net.in_cidr(F.col(ip), net_, mask))
    if start is not None:
        out = out.where(F.col(stop_column) >= start)
    if stop is not None:
        out = out.where(F.col(start_column) < stop)
    return out


def invalid_rows(rows: DataFrame, start: str = "start", stop: str = "stop", measures: tuple[str, ...] = ()) -> DataFrame:
    """Rows that a table should not have: times missing or reversed, negative measures."""
    bad = F.col(start).isNull() | F.col(stop).isNull() | (F.col(start) > F.col(stop))
    for m in measures:
        bad = bad | (F.coalesce(F.col(m), F.lit(0)) < 0)
    return rows.where(bad)


def retained(rows: DataFrame, now: int, max_age: int, ts: str = "stop") -> DataFrame:
    """Rows that a retention of ``max_age`` milliseconds keeps."""
    return rows.where(F.col(ts) >= now - max_age)


def compact(spark: SparkSession, path: str, out: str, files: int | None = None) -> None:
    """Rewrite a table with few, time-ordered files a bucket: tasks write ranges of (bucket, time), ``files`` of them or as many as Spark shuffles to."""
    rows = spark.read.parquet(path)
    ranges = rows.repartitionByRange("ip_bucket", "start") if files is None else rows.repartitionByRange(files, "ip_bucket", "start")
    ranges.sortWithinPartitions("ip_bucket", "start").write.partitionBy("ip_bucket").mode("overwrite").parquet(out)


def geo_join(rows: DataFrame, ip: str, geo: DataFrame, prefix: str) -> DataFrame:
    """Location (country, lat, lon) of an address by a table of ranges (low, high); unknown is ('', 0, 0).

    Ranges are cut along /16 blocks so that the join has an equality and no row meets all ranges.
    """
    wide = geo.withColumn("_b", F.explode(F.sequence(F.shiftright("low", 16), F.shiftright("high", 16))))
    wide = wide.select("_b", F.col("low").alias("_lo"), F.col("high").alias("_hi"), *[F.col(c).alias(prefix + c) for c in ("country", "lat", "lon")])
    near = (F.shiftright(F.col(ip), 16) == F.col("_b")) & F.col(ip).between(F.col("_lo"), F.col("_hi"))
    out = rows.join(wide, near, "left").drop("_b", "_lo", "_hi")
    return out.fillna({f"{prefix}country": "", f"{prefix}lat": 0.0, f"{prefix}lon": 0.0})


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as traffic rows."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    address = "concat('02:00:00:00:00:', lower(lpad(hex({} % 16), 2, '0')))"
    return rows.select(
        F.least(times.millis("o_orderdate"), times.millis("l_shipdate")).alias("start"),
        F.greatest(times.millis("o_orderdate"), times.millis("l_shipdate")).alias("stop"),
        F.col("l_quantity").cast("long").alias("packets"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("eth_payload"),
        (F.lit(167772160) + F.col("l_suppkey")).alias("ip_src"),
        (F.lit(3232235520) + F.col("o_custkey")).alias("ip_dst"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 6 WHEN 'N' THEN 17 ELSE 1 END").alias("ip_proto"),
        F.expr("CASE l_linestatus WHEN 'F' THEN 2048 ELSE 2054 END").alias("eth_proto"),
        (F.lit(1024) + F.col("l_partkey") % 1000).cast("int").alias("port_src"),
        (F.substring("o_orderpriority", 1, 1).cast("int") * 100).alias("port_dst"),
        F.expr("CASE WHEN l_discount = 0 THEN NULL ELSE CAST(round(l_discount * 100) AS INT) END").alias("vlan"),
        (F.lit(1400) + F.round(F.col("l_tax") * 100)).cast("int").alias("mtu"),
        F.expr(address.format("l_suppkey")).alias("mac_src"),
        F.expr(address.format("o_custkey")).alias("mac_dst"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as name-server transactions; response times in seconds."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", times.millis("ts").alias("start"), (F.col("value") / 1000).alias("rt"), (F.lit(167772160) + F.col("user_id")).alias("ip_srv"),
        (F.lit(3232235520) + F.col("event_id") % 1000).alias("ip_clt"), F.expr("CASE event_type WHEN 'error' THEN 3 ELSE 0 END").alias("error"),
        F.col("event_type").alias("name"),
    )


def web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as web requests, in the columns of the web table."""
    t = transactions(spark, sf_dir)
    return t.select(
        "event_id", F.lit(None).cast("int").alias("vlan"), "ip_clt", "ip_srv", F.expr("CASE WHEN event_id % 3 = 0 THEN 8080 ELSE 80 END").alias("port_srv"),
        (F.col("event_id") % 8).cast("int").alias("methd"),
        F.expr("CASE WHEN error <> 0 THEN 500 WHEN event_id % 10 = 7 THEN 404 ELSE 200 END").alias("status"), "start",
        F.lit(1).cast("long").alias("rt_count"), F.col("rt").alias("rt_min"), F.col("rt").alias("rt_max"), F.col("rt").alias("rt_avg"), F.lit(0.0).alias("rt_m2"),
        F.expr("concat('www.h', (ip_srv - 167772160) % 7, '.example')").alias("host"), F.expr("concat('/', name, '/', event_id % 50, '?k=', event_id % 9)").alias("url"),
    )


def tcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as socket openings, in the columns of the socket table."""
    t = transactions(spark, sf_dir)
    return t.select(
        "event_id", F.lit(None).cast("int").alias("vlan"), "ip_clt", "ip_srv", (1024 + F.col("event_id") % 5000).cast("int").alias("port_clt"),
        F.expr("CASE WHEN event_id % 5 = 0 THEN 22 ELSE 443 END").alias("port_srv"), "start", (1 + F.col("event_id") % 4).alias("syns"),
        F.lit(1).cast("long").alias("rt_count"), *[(F.col("rt") / 10).alias(f"rt_{x}") for x in ("min", "max", "avg")], F.lit(0.0).alias("rt_m2"),
    )


#: Start of the packets' time in microseconds; it runs 3000 times as fast as that of the events they are made of.
PACKETS_FROM, PACKETS_SPEED = 1_704_067_200_000_000, 3000


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets of 50 conversations, a seventh of them below addresses, a third without ports."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    pair, up = F.col("user_id") % 50, F.col("event_id") % 3 != 0
    no_ip, size = pair % 7 == 6, F.floor("value").cast("long")
    us = F.lit(PACKETS_FROM) + times.div(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") - PACKETS_FROM, PACKETS_SPEED)
    address = lambda a, b: F.when(~no_ip, F.when(up, a).otherwise(b))
    clt, srv = F.lit(167772160) + pair, F.lit(3232235520) + pair % 5
    mac = lambda x: F.concat(F.lit("02:00:00:00:00:"), F.lower(F.lpad(F.hex(x), 2, "0")))
    return rows.select(
        F.col("event_id").alias("n"), F.timestamp_micros(us).alias("ts"), F.when(up, mac(pair)).otherwise(mac(pair % 5 + 100)).alias("mac_src"),
        F.when(up, mac(pair % 5 + 100)).otherwise(mac(pair)).alias("mac_dst"), F.when(no_ip, 2054).otherwise(2048).alias("eth_proto"),
        address(clt, srv).alias("ip_src"), address(srv, clt).alias("ip_dst"),
        F.when(~no_ip, F.when(pair % 3 == 0, 6).when(pair % 3 == 1, 17).otherwise(1)).alias("ip_proto"),
        address(1024 + pair, F.lit(443).cast("long")).cast("int").alias("port_src"), address(F.lit(443).cast("long"), 1024 + pair).cast("int").alias("port_dst"),
        (F.col("event_type") == "view").alias("syn"), (F.col("event_type") == "click").alias("ack"), (size + 40).alias("eth_payload"), (size + 20).alias("ip_payload"),
        size.alias("l4_payload"), size.alias("payload"),
    )


#: The same views in DuckDB's SQL.
TRAFFIC_SQL = """traffic AS (SELECT epoch_us(least(o_orderdate, l_shipdate)) // 1000 AS start, epoch_us(greatest(o_orderdate, l_shipdate)) // 1000 AS stop,
 CAST(l_quantity AS BIGINT) AS packets, CAST(round(l_extendedprice * 100) AS BIGINT) AS eth_payload, 167772160 + l_suppkey AS ip_src,
 3232235520 + o_custkey AS ip_dst, CASE l_returnflag WHEN 'A' THEN 6 WHEN 'N' THEN 17 ELSE 1 END AS ip_proto,
 CASE l_linestatus WHEN 'F' THEN 2048 ELSE 2054 END AS eth_proto, CAST(1024 + l_partkey % 1000 AS INT) AS port_src,
 CAST(substr(o_orderpriority, 1, 1) AS INT) * 100 AS port_dst, CASE WHEN l_discount = 0 THEN NULL ELSE CAST(round(l_discount * 100) AS INT) END AS vlan,
 CAST(1400 + round(l_tax * 100) AS INT) AS mtu, '02:00:00:00:00:' || lower(lpad(to_hex(l_suppkey % 16), 2, '0')) AS mac_src,
 '02:00:00:00:00:' || lower(lpad(to_hex(o_custkey % 16), 2, '0')) AS mac_dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
TRANSACTIONS_SQL = """tx AS (SELECT event_id, epoch_us(ts) // 1000 AS start, value / 1000.0 AS rt, 167772160 + user_id AS ip_srv,
 3232235520 + event_id % 1000 AS ip_clt, CASE event_type WHEN 'error' THEN 3 ELSE 0 END AS error, event_type AS name FROM events)"""
WEB_SQL = """web AS (SELECT event_id, CAST(NULL AS INT) AS vlan, ip_clt, ip_srv, CASE WHEN event_id % 3 = 0 THEN 8080 ELSE 80 END AS port_srv, CAST(event_id % 8 AS INT) AS methd,
 CASE WHEN error <> 0 THEN 500 WHEN event_id % 10 = 7 THEN 404 ELSE 200 END AS status, start, 1::BIGINT AS rt_count, rt AS rt_min, rt AS rt_max, rt AS rt_avg, 0.0::DOUBLE AS rt_m2,
 'www.h' || (ip_srv - 167772160) % 7 || '.example' AS host, '/' || name || '/' || event_id % 50 || '?k=' || event_id % 9 AS url FROM tx)"""
TCP_SQL = """tcp AS (SELECT event_id, CAST(NULL AS INT) AS vlan, ip_clt, ip_srv, CAST(1024 + event_id % 5000 AS INT) AS port_clt, CASE WHEN event_id % 5 = 0 THEN 22 ELSE 443 END AS port_srv,
 start, 1 + event_id % 4 AS syns, 1::BIGINT AS rt_count, rt / 10 AS rt_min, rt / 10 AS rt_max, rt / 10 AS rt_avg, 0.0::DOUBLE AS rt_m2 FROM tx)"""
PACKETS_SQL = f"""packets AS (SELECT n, us, CASE WHEN up THEN mc ELSE ms END AS mac_src, CASE WHEN up THEN ms ELSE mc END AS mac_dst, CASE WHEN no_ip THEN 2054 ELSE 2048 END AS eth_proto,
 CASE WHEN no_ip THEN NULL WHEN up THEN clt ELSE srv END AS ip_src, CASE WHEN no_ip THEN NULL WHEN up THEN srv ELSE clt END AS ip_dst,
 CASE WHEN no_ip THEN NULL WHEN pair % 3 = 0 THEN 6 WHEN pair % 3 = 1 THEN 17 ELSE 1 END AS ip_proto,
 CAST(CASE WHEN no_ip THEN NULL WHEN up THEN 1024 + pair ELSE 443 END AS INT) AS port_src, CAST(CASE WHEN no_ip THEN NULL WHEN up THEN 443 ELSE 1024 + pair END AS INT) AS port_dst,
 syn, ack, size + 40 AS eth_payload, size + 20 AS ip_payload, size AS l4_payload, size AS payload, up, pair FROM (SELECT *, 167772160 + pair AS clt, 3232235520 + pair % 5 AS srv,
 '02:00:00:00:00:' || lower(lpad(to_hex(pair), 2, '0')) AS mc, '02:00:00:00:00:' || lower(lpad(to_hex(pair % 5 + 100), 2, '0')) AS ms, pair % 7 = 6 AS no_ip FROM
 (SELECT event_id AS n, {PACKETS_FROM} + (epoch_us(ts) - {PACKETS_FROM}) // {PACKETS_SPEED} AS us, user_id % 50 AS pair, event_id % 3 <> 0 AS up, CAST(floor(value) AS BIGINT) AS size,
 event_type = 'view' AS syn, event_type = 'click' AS ack FROM events)))"""
