"""First answers, sockets, flows and traffic: tables against plain loops and DuckDB, streams against tables."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from meshlens.sources import facts
from meshlens.streaming import packets

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FAR = 10**6


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    yield
    spark.conf.set(STORE, before)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def arriving(spark, df, parts, ts="ts"):
    """``df`` as a stream of several files: out of order by a few seconds, then one row in the far future."""
    path = tempfile.mkdtemp(prefix="spark-")
    late = F.unix_micros(ts) / 1e6 + F.pmod(F.hash("n"), F.lit(5))  # arrives up to four seconds after others of its time
    low, high = df.select(late.alias("x")).agg(F.min("x"), F.max("x")).first()
    for i in range(parts):
        a, b = low + (high - low) * i / parts, low + (high - low) * (i + 1) / parts
        df.where((late >= a) & ((late < b) | F.lit(i == parts - 1))).coalesce(1).write.mode("append").parquet(path)
    end = df.limit(1).withColumn(ts, F.timestamp_seconds(F.unix_seconds(ts) + FAR)).withColumn("n", F.lit(-1).cast("long"))
    end = end.withColumn("payload", F.lit(1).cast("long")) if "payload" in df.columns else end
    end.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream):
    out = tempfile.mkdtemp(prefix="spark-")
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True)
    query = writer.start()
    assert query.awaitTermination(180)
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def talk(rng, n):
    """(n, ms, key, query?) with a busy key, equal times and pauses."""
    return [(i, 10**6 + rng.choice([rng.randrange(60_000), 30_000, 30_500]), rng.choice([1, 1, 1, 2, 3, None]), rng.random() < 0.6) for i in range(n)]


def test_first_answers_equal_search_by_hand(spark):
    said = talk(random.Random(3), 400)
    df = spark.createDataFrame(said, "n long, ms long, k int, asks boolean").withColumn("ts", F.timestamp_millis("ms"))
    df = df.unionByName(spark.createDataFrame([(900, None, 1, True), (901, None, 1, False)], "n long, ms long, k int, asks boolean").withColumn("ts", F.timestamp_millis("ms")))
    want = []
    for n, ms, k, asks in [*said, (900, None, 1, True)]:
        if asks:
            best = min(((t, i) for i, t, x, y in said if ms is not None and not y and x == k and k is not None and ms <= t <= ms + 1500), default=None)
            want.append((n, best and best[1], best and (best[0] - ms) / 1e3 or 0.0, best is None))
    q, a = df.where("asks"), df.where("NOT asks")
    got = packets.first_answers(q, a, ["k"], 1500, keep_unanswered=True)
    assert rows(got.select("q_n", "a_n", "rt", "timed_out")) == sorted(want, key=str)
    assert any(w[3] for w in want) and any(w[1] is not None and w[2] == 0 for w in want)
    answered = packets.first_answers(q, a, ["k"], 1500)
    assert rows(answered.select("q_n")) == sorted(((w[0],) for w in want if not w[3]), key=str)
    assert packets.first_answers(q.limit(0), a, ["k"], 1500).count() == 0
    assert packets.first_answers(q, a.limit(0), ["k"], 1500, keep_unanswered=True).where("timed_out").count() == q.count()


def test_a_busy_key_is_spread_and_sorted_once(spark):
    df = spark.range(10).select(F.col("id").alias("n"), F.lit(1).alias("k"), F.timestamp_seconds("id").alias("ts"))
    plan = packets.first_answers(df, df, ["k"], 1000)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Window ") == 1 and "hashpartitioning(k" in plan and "_bin" in plan


def test_first_answers_of_streams(spark, rocks):
    said = [x for x in talk(random.Random(6), 300) if x[2]]
    df = spark.createDataFrame(said, "n long, ms long, k int, asks boolean").withColumn("ts", F.timestamp_millis("ms"))
    want = rows(packets.first_answers(df.where("asks"), df.where("NOT asks"), ["k"], 1500, keep_unanswered=True))
    stream = arriving(spark, df, 4)
    got = run(packets.first_answers_stream(stream.where("asks"), stream.where("NOT asks"), ["k"], 1500, "10 seconds", keep_unanswered=True))
    assert rows(got.where("q_n >= 0")) == want


def traffic_of(rng, n):
    """Packets of a few ends in both directions, with hardware-only ones and pauses."""
    out = []
    for i in range(n):
        a, up, ms = rng.randrange(4), rng.random() < 0.6, 10**6 + rng.randrange(300) * 250
        src, dst = (10 + a, 1000 + a), (99, 80)
        kind = (6, 17, 1, None)[a]
        (s, sp), (d, dp) = (src, dst) if up else (dst, src)
        ip = [None] * 4 if kind is None else [s, sp, d, dp]
        out.append((i, ms, f"m{a if up else 9}", f"m{9 if up else a}", 2048, *ip, kind, rng.random() < 0.3, rng.random() < 0.3, rng.randrange(0, 3) * 100))
    return out


def as_packets(spark, made):
    df = spark.createDataFrame(made, "n long, ms long, mac_src string, mac_dst string, eth_proto int, ip_src long, port_src int, ip_dst long, port_dst int, ip_proto int, syn boolean, ack boolean, payload long")
    size = {f"{x}_payload": F.col("payload") + k for x, k in (("eth", 40), ("ip", 20), ("l4", 0))}
    return df.withColumns({"ts": F.timestamp_millis("ms")} | size).drop("ms")


def opened(made, timeout):
    """Sockets by a plain loop over each conversation."""
    out, held = [], {}
    for n, ms, *_, s, sp, d, dp, kind, syn, ack, _ in sorted(made, key=lambda x: (x[1], x[0])):
        ends = frozenset([(s, sp), (d, dp)])
        now = held.get(ends)
        if now and ms - now[1] > timeout:
            out.append((*now, 0.0, True))
            now = None
        if now and ack and now[0] == (s, sp, d, dp):
            out.append((*now, (ms - now[1]) / 1e3, False))
            now = None
        elif syn:
            now = (now[0], now[1], now[2] + 1) if now else ((s, sp, d, dp), ms, 1)
        held[ends] = now
    out += [(*x, 0.0, True) for x in held.values() if x]
    return sorted(((*e, ms, n, ct, late) for e, ms, n, ct, late in out), key=str)


def test_sockets_table_and_stream(spark, rocks):
    made = [x for x in traffic_of(random.Random(12), 400) if x[9]]
    df = as_packets(spark, made)
    shown = ["ip_clt", "port_clt", "ip_srv", "port_srv", F.unix_millis("ts"), "syns", "ct", "timed_out"]
    table = packets.sockets(df, 3000)
    assert rows(table.select(*shown)) == opened(made, 3000)
    got = run(packets.sockets(arriving(spark, df, 4), 3000, delay="10 seconds"))
    assert rows(got.where(F.year("ts") == 1970).where(F.unix_seconds("ts") < FAR)) == rows(table)


def test_flows_table_and_stream(spark, rocks):
    df = as_packets(spark, [x for x in traffic_of(random.Random(13), 400) if x[9]])
    table = packets.flows(df, 500)
    assert table.where("packets > 1").count() > 20
    assert table.agg(F.sum("payload")).first()[0] == df.agg(F.sum("payload")).first()[0]
    got = run(packets.flows(arriving(spark, df, 4), 500, delay="10 seconds"))
    assert rows(got.where(F.unix_seconds("start") < FAR)) == rows(table)
    turn = as_packets(spark, [(1, 0, "a", "b", 2048, 1, 5, 2, 80, 6, False, False, 10), (2, 100, "b", "a", 2048, 2, 80, 1, 5, 6, False, False, 7), (3, 200, "a", "b", 2048, 1, 5, 2, 80, 6, False, False, 10),
                              (4, 250, "b", "a", 2048, 2, 80, 1, 5, 6, False, False, 0), (5, 300, "a", "b", 2048, 1, 5, 2, 80, 6, False, False, 1), (6, 801, "a", "b", 2048, 1, 5, 2, 80, 6, False, False, 1)])
    assert rows(packets.flows(turn, 500).select("ip_src", "packets", "payload")) == [(1, 1, 1), (1, 1, 10), (1, 2, 11), (2, 1, 7)]


def test_traffic_table_and_stream(spark, rocks):
    df = as_packets(spark, traffic_of(random.Random(14), 400))
    table = packets.traffic(df, 20_000)
    kinds = {(r.ip_src is not None, r.port_src is not None) for r in table.collect()}
    assert kinds == {(False, False), (True, False), (True, True)}
    sums = lambda d: tuple(d.agg(F.sum("packets"), F.sum("eth_payload")).first())
    assert sums(table) == tuple(df.agg(F.count("*"), F.sum("eth_payload")).first())
    assert table.where(F.unix_micros("stop") - F.unix_micros("start") > 20_000_000).count() == 0
    got = run(packets.traffic(arriving(spark, df, 4), 20_000, delay="10 seconds"))
    assert rows(got.where(F.unix_seconds("start") < FAR)) == rows(table)


def test_empty_packets(spark):
    none = as_packets(spark, traffic_of(random.Random(1), 3)).limit(0)
    assert packets.sockets(none).count() == packets.flows(none).count() == packets.traffic(none).count() == 0


@pytest.mark.parametrize("name", ["http_match_join", "dns_first_answer", "socket_openings", "flow_sessions", "traffic_sessions"])
def test_packet_queries_against_duckdb(spark, name):
    import duckdb

    from meshlens.plans import catalog_queries

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    got, want = catalog_queries.queries()[name](spark, d), con.sql(catalog_queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert rows(got.select(*columns)) == sorted(want.select(*columns).fetchall(), key=str)
    assert facts.packets(spark, d).count() == spark.read.parquet(f"{d}/events.parquet").count()
