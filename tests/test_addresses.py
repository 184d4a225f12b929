"""Addresses of both families against the standard library, joins by prefix, and clients that are subnets."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from meshlens.functions import addresses
from meshlens.operators import presets, rollups

TEXTS = [
    "1.2.3.4", "255.255.255.255", "0.0.0.0", "256.1.1.1", "1.2.3", "::", "::1", "1::", "2001:DB8:0:0:1:0:0:1", "::ffff:1.2.3.4", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3",
    ":::", ":1", "1:", "12345::", "g::", "", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.256", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1.2.3.4:5", "::1:", "1:0:0:2::3",
    "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "8000::8000:0:0:0", " 1.2.3.4", None, "1.2.3.4.5", "1:0:3:0:5:0:7:0", "0:0:3::",
]


def number(a):
    return None if a is None else (a.family, (a.hi & (1 << 64) - 1) << 64 | a.lo & (1 << 64) - 1)


def by_library(text):
    try:
        at = ipaddress.ip_address(text)
    except ValueError:
        return None, None
    shown = str(at) if at.version == 4 or at.ipv4_mapped is None else "::ffff:" + ":".join(f"{int(at) >> s & 0xFFFF:x}" for s in (16, 0))
    return (at.version, int(at) << (128 - at.max_prefixlen)), shown


def texts(rng, n):
    out = []
    for _ in range(n):
        x = rng.getrandbits(128)
        for k in range(8):
            if rng.random() < 0.5:
                x &= ~(0xFFFF << 16 * k)
        at = ipaddress.IPv6Address(x)
        out += [str(at), at.exploded, str(ipaddress.IPv4Address(rng.getrandbits(32)))]
    return out


def test_parsed_and_shown_as_the_library_does(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS + texts(random.Random(2), 120)], "t string")
    a = addresses.parse(F.col("t"))
    for r in df.select("t", a.alias("a"), addresses.display(a).alias("s")).collect():
        assert (number(r.a), r.s) == by_library(r.t), r.t


def test_first_subnet_that_holds_an_address(spark):
    rng = random.Random(7)
    hosts = [t for t in texts(rng, 60)] + [f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(256)}" for _ in range(80)] + [f"2001:db8:{rng.randrange(4):x}::{rng.randrange(9):x}" for _ in range(80)]
    subnets = ["10.1.2.0/24", "10.0.0.0/9", "10.1.0.0/16", "10.2.3.128/25", "2001:db8:2::/47", "2001:db8::/32", "2001:db8:1::3/128", "10.1.1.1/32", "0.0.0.0/1", "10.1.2.0/24", "8000::/1"]
    nets = [ipaddress.ip_network(s) for s in subnets]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*hosts, None, "no address"])], "i long, t string, name string").withColumn("ip", addresses.parse(F.col("t")))
    got = {r.i: r for r in addresses.subnet_of(df, "ip", addresses.subnet_table(spark, subnets), rank="rank").collect()}
    assert len(got) == len(hosts) + 2 and got[len(hosts)].net is None and got[len(hosts)].mask is None
    for i, t in enumerate(hosts):
        at = ipaddress.ip_address(t)
        first = next((k for k, n in enumerate(nets) if n.version == at.version and at in n), None)
        want = nets[first] if first is not None else ipaddress.ip_network(t)
        assert (got[i].rank, got[i].mask) == (first, want.prefixlen)
        assert number(got[i].net) == (at.version, int(want.network_address) << (128 - at.max_prefixlen))
    alone = addresses.subnet_of(df, "ip", addresses.subnet_table(spark, subnets).limit(0)).where("ip IS NOT NULL")
    assert alone.where("net = ip").count() == len(hosts) and addresses.subnet_of(df.limit(0), "ip", addresses.subnet_table(spark, subnets)).count() == 0


def test_one_join_for_each_length(spark):
    df = spark.createDataFrame([("1.2.3.4",)], "t string").select(addresses.parse(F.col("t")).alias("ip"))
    many = [f"{a}.{b}.0.0/16" for a in range(10) for b in range(10)] + [f"9.{a}.0.0/20" for a in range(50)] + ["9.0.0.0/8"]
    plan = addresses.subnet_of(df, "ip", addresses.subnet_table(spark, many))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 3 and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("subnets", [["10.0.1.0/24", "10.0.0.0/16"], [((10 << 24) + 256, 24), (10 << 24, 16)]])
def test_rollups_by_client_subnet_can_be_filtered_again(spark, subnets):
    rows = [((10 << 24) + i * 37 % 1000 + (i % 3 << 16), i % 4, i * 700) for i in range(300)]
    one = F.struct(F.lit(1).cast("long").alias("count"), *[F.lit(1.0).alias(c) for c in ("min", "max", "avg")], F.lit(0.0).alias("m2"))
    df = spark.createDataFrame(rows, "ip_clt long, ip_srv long, start long").withColumns({"rt": one, "syns": F.lit(2).cast("long")})
    minutes = rollups.transaction_rollup(df, ["ip_clt", "ip_srv"], 60_000, subnets=subnets, sums=("syns",))
    hours = rollups.transaction_rollup(minutes, ["ip_clt", "ip_srv"], 3_600_000, subnets=subnets, sums=("syns",))
    assert hours.agg(F.sum("rt.count"), F.sum("syns")).first()[:] == (300, 600)
    for client, net in (("10.0.1.7", "10.0.1.7/32"), ("10.0.0.0/8", "10.0.0.0/8"), ("10.1.0.0/25", "10.1.0.0/25"), (((10 << 24) + 512, 23), "10.0.2.0/23"), ("::/0", None)):
        asked = net and ipaddress.ip_network(net)

        def held(ip):
            own = next((n for n in (ipaddress.ip_network("10.0.1.0/24"), ipaddress.ip_network("10.0.0.0/16")) if ipaddress.ip_address(ip) in n), ipaddress.ip_network(ip))
            return asked is not None and own.overlaps(asked)

        want = sum(held(r[0]) for r in rows)
        for level in (minutes, hours):
            assert (presets.transactions(level, client=client).agg(F.sum("rt.count")).first()[0] or 0) == want


def test_presets_take_both_families(spark):
    df = spark.createDataFrame([("10.0.0.1", "2001:db8::1"), ("2001:db8::1", "10.9.0.1"), ("::1", "::2")], "a string, b string")
    df = df.select(*[addresses.parse(F.col(x)).alias(y) for x, y in (("a", "ip_src"), ("b", "ip_dst"))])
    assert presets.traffic(df, ip="2001:db8::/32").count() == 2 and presets.traffic(df, ip="10.0.0.0/8").count() == 2
    assert presets.traffic(df, ip_src="::1").count() == 1 and presets.traffic(df, ip_dst="0.0.0.0/0").count() == 1


def test_small_subnets_are_spelled_out(spark):
    df = spark.createDataFrame([("10.0.0.9", 30), ("2001:db8::ffff", 126), ("::", 64), ("10.0.0.0", 8)], "t string, m int").withColumn("ip", addresses.parse(F.col("t")))
    each = [[addresses_of(x) for x in r[0] or []] for r in df.select(addresses.spelled_out(F.col("ip"), F.col("m"))).collect()]
    for found, net in zip(each, ("10.0.0.8/30", "2001:db8::fffc/126")):
        assert found == [str(x) for x in ipaddress.ip_network(net)]
    assert each[2:] == [[], []]


def addresses_of(a):
    family, n = number(a)
    return str(ipaddress.IPv4Address(n >> 96) if family == 4 else ipaddress.IPv6Address(n))
