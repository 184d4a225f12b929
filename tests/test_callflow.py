"""Call flow against breadth-first search by hand: over all flows that overlap, until no new host is left."""

import random

from meshlens.operators import graphs
from meshlens.plans import catalog_queries


def searched(flows, host, start, stop):
    seen, frontier, out, hop = {host}, {host: (start, stop - 1)}, [], 0
    while frontier:
        hop, reach = hop + 1, {}
        for src, dst, a, b, y in flows:
            if src in frontier and b >= frontier[src][0] and a <= frontier[src][1]:
                t0, _ = frontier[src]
                out.append((hop, src, dst, a, b, y))
                if dst not in seen:
                    old = reach.get(dst, (stop, start))
                    reach[dst] = (min(old[0], max(a, t0)), max(old[1], min(b, stop - 1)))
        seen |= reach.keys()
        frontier = reach
    return sorted(out)


def test_callflow_goes_on_until_no_host_is_new(spark):
    chain = [(k, k + 1, 10 * k, 10 * k + 25, k) for k in range(20)]
    late = [(3, 90, 41, 300, 7), (90, 91, 250, 260, 8), (3, 93, 45, 900, 7), (93, 94, 500, 510, 9)]  # 93 is reached beyond the time asked for
    rng = random.Random(31)
    more = [(rng.randrange(40, 60), rng.randrange(40, 60), a := rng.randrange(200), a + rng.randrange(80), 1) for _ in range(60)]
    flows = [*chain, *late, *more, (0, 40, -5, 5, 2)]
    df = spark.createDataFrame(flows, "ip_src long, ip_dst long, start long, stop long, y long")
    want = searched(flows, 0, 0, 400)
    assert max(x[0] for x in want) > 16
    assert sorted(map(tuple, graphs.callflow(df, 0, 0, 400).collect())) == want


def test_callflow_query_takes_all_flows_that_overlap(spark):
    d = "/root/testdata/sf0.001"
    flows = [tuple(r) for r in catalog_queries._flows(spark, d).collect()]
    want = searched(flows, 7, catalog_queries.START, catalog_queries.START + 4 * catalog_queries.WEEK)
    assert want and sorted(map(tuple, catalog_queries.callflow(spark, d).collect())) == want
