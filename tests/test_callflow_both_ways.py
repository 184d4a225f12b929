"""Interval joins, and the call flow in both directions, against plain loops."""

import random
from collections import Counter

from meshlens.operators import callflow, intervals

FLOWS = "ip_src long, ip_dst long, ip_proto int, port_src int, port_dst int, start long, stop long, packets long, payload long, hop string"
TRANSACTIONS = "kind string, ip_clt long, ip_srv long, start long, stop long, request string, response string, peer int"


def test_interval_join_equals_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), a := rng.randrange(-50, 1050), a + rng.choice([0, 1, 30, 900])) for i in range(300)]
    windows = [(i, rng.choice("aab"), a := rng.randrange(-50, 1050), a + rng.choice([0, 1, 40, 700])) for i in range(60)]
    rows += [(900, "a", None, 5), (901, "a", 5, None), (902, "a", 9, 3)]
    left, right = spark.createDataFrame(rows, "r long, k string, start long, stop long"), spark.createDataFrame(windows, "w long, key string, t0 long, t1 long")

    def met(lo, hi):
        return {
            (r, w) for r, k, a, b in rows for w, key, c, d in windows
            if k == key and a is not None and b is not None and a <= b and b >= c and a < d and lo <= max(a, c) < hi
        }

    for lo, hi, bins in ((-100, 2000, 1), (-100, 2000, 7), (-100, 2000, 64)):
        got = [(x.r, x.w) for x in intervals.interval_join(left, right, {"k": "key"}, lo, hi, bins=bins).collect()]
        assert len(got) == len(set(got)) and set(got) == met(lo, hi)
    assert intervals.interval_join(left.limit(0), right, {"k": "key"}, 0, 9).count() == 0


def test_merged_windows_cover_the_same_time(spark):
    rng = random.Random(8)
    windows = [(rng.choice([1, 2, None]), a := rng.randrange(100), a + rng.randrange(9)) for _ in range(60)]
    got = intervals.merge_windows(spark.createDataFrame(windows, "k int, t0 long, t1 long"), ["k"]).collect()
    for k in (1, 2, None):
        own = sorted((r.t0, r.t1) for r in got if r.k == k)
        assert all(a[1] < b[0] for a, b in zip(own, own[1:]))
        assert {t for a, b in own for t in range(a, b)} == {t for x, a, b in windows if x == k for t in range(a, b)}


def share(v, a, b, lo, hi):
    first = v * (b - lo) // max(b - a, 1) if a < lo else v
    s = max(a, lo)
    return first * (hi - s) // max(b - s, 1) if b > hi else first


def searched(flows, transactions, host, start, stop, given=(None,) * 4):
    out, seen, frontier, hop = Counter(), {host}, {host: (start, stop)}, 0
    while frontier:
        hop, reach, served = hop + 1, {}, set()
        for node, (t0, t1) in frontier.items():
            contacts = {}
            for f in flows:
                if f[0] == node and f[6] >= t0 and f[5] < t1 and (hop > 1 or all(v is None or v == x for v, x in zip(given, f[1:5]))):
                    out[(hop, "flow", max(f[5], t0), min(f[6], t1), *f[:5], share(f[7], *f[5:7], t0, t1), share(f[8], *f[5:7], t0, t1), None, None)] += 1
                    contacts[f[1:5]] = min(contacts.get(f[1:5], t1), max(f[5], t0))
            for (peer, proto, own, their), first in contacts.items():
                last = first
                for f in flows:
                    if f[:5] == (peer, node, proto, their, own) and f[6] >= first and f[5] < t1:
                        out[(hop, "back", max(f[5], t0), min(f[6], t1), *f[:5], share(f[7], *f[5:7], t0, t1), share(f[8], *f[5:7], t0, t1), None, None)] += 1
                        last = max(last, min(f[6], t1))
                served |= {i for i, t in enumerate(transactions) if t[2] == peer and first <= t[3] < last}
                old = reach.get(peer, (first, last))
                reach[peer] = (min(old[0], first), max(old[1], last))
        for i in served:
            kind, clt, srv, a, b, request, response = transactions[i]
            out[(hop, kind, a, b, clt, srv, None, None, None, None, None, request, response)] += 1
        frontier = {k: v for k, v in reach.items() if k not in seen}
        seen |= reach.keys()
    return out


def made(rng, hosts, n):
    flows = []
    for _ in range(n):
        a, b, port = rng.randrange(hosts), rng.randrange(hosts), rng.randrange(3)
        at, proto = rng.randrange(1000), rng.choice([6, 17])
        flows.append((a, b, proto, port, 80, at, at + rng.randrange(60), rng.randrange(1, 99), rng.randrange(10**12)))
        if rng.random() < 0.7:
            back = at + rng.randrange(-5, 90)
            flows.append((b, a, proto, 80, port, back, back + rng.randrange(60), rng.randrange(1, 9), rng.randrange(10**6)))
    asked = [(rng.choice(["dns", "web", "tcp"]), rng.randrange(hosts), rng.randrange(hosts), t := rng.randrange(1000), t + 3, f"q{i % 7}", "") for i in range(n)]
    return flows, asked


def test_both_ways_equals_search_by_hand(spark):
    rng = random.Random(17)
    depths = []
    for hosts, n, given in ((60, 90, {}), (12, 100, {"ip_proto": 6, "port_dst": 80})):
        flows, asked = made(rng, hosts, n)
        flows += flows[:3]
        chain = [3, 100, 101, 102, 103, 104]
        for k, (a, b) in enumerate(zip(chain, chain[1:])):
            flows += [(a, b, 6, 1, 80, 120 + 20 * k, 125 + 20 * k, 4, 9**k), (b, a, 6, 80, 1, 130 + 20 * k, 950 - 9 * k, 7, 10**k)]
        want = searched(flows, asked, 3, 100, 900, tuple(given.get(k) for k in ("ip_dst", "ip_proto", "port_src", "port_dst")))
        df = spark.createDataFrame([(*f, "x") for f in [*flows, (None, 3, 6, 1, 1, 5, 500, 1, 1), (3, None, 6, 1, 1, None, 500, 1, 1)]], FLOWS)
        tx = spark.createDataFrame([(*t, 1) for t in asked], TRANSACTIONS)
        got = Counter(map(tuple, callflow.callflow(df, 3, 900, 100, tx, **given).collect()))
        assert got == want
        assert {x[1] for x in want} >= {"flow", "back"}
        depths.append(max(x[0] for x in want))
    assert max(depths) > 4


def test_callflow_of_nothing_and_for_some_hops(spark):
    flows, asked = made(random.Random(1), 9, 40)
    df, tx = spark.createDataFrame([(*f, "x") for f in flows], FLOWS), spark.createDataFrame([(*t, 1) for t in asked], TRANSACTIONS)
    assert callflow.callflow(df.limit(0), 3, 0, 900, tx.limit(0)).count() == callflow.callflow(df, 77, 0, 900, tx).count() == 0
    one = callflow.callflow(df, 3, 0, 900, max_hops=1)
    assert {r.hop for r in one.collect()} == {1}
    shown = callflow.described(one).first()
    assert shown.grp.startswith(("tcp/", "udp/")) and "→" in shown.label and shown.peer1 == "0.0.0.3"


def test_flows_are_read_by_source(spark):
    from meshlens.sources.staging import staged

    flows, _ = made(random.Random(1), 9, 40)
    df = staged(spark.createDataFrame([(*f, "x") for f in flows], FLOWS), "flows")
    few = callflow._only(df, spark.createDataFrame([(3,), (4,)], "node long"), "ip_src", "node")
    assert "PushedFilters: [In(ip_src, [3,4])]" in few._jdf.queryExecution().toString()
