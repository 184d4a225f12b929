"""Call flow: what a host may have set off, hop by hop, in both directions and with the transactions of the hosts it reached."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.functions import labels, net, numbers
from meshlens.operators.intervals import interval_join, merge_windows
from meshlens.operators.top import portion
from meshlens.sources.staging import small_side, staged

#: Rows of a call flow: flows have ports, packets and payload, transactions what they asked for and the answer.
CALLFLOW = (
    "hop int, kind string, start long, stop long, ip_src long, ip_dst long, ip_proto int, port_src int, port_dst int, packets long, payload long, "
    "request string, response string"
)
_FLOW = ["ip_src", "ip_dst", "ip_proto", "port_src", "port_dst", "start", "stop", "packets", "payload"]
#: A frontier of at most so many hosts is pushed into the scan of the flows.
PUSHED_HOSTS = 200


def _only(flows: DataFrame, hosts: DataFrame, column: str, node: str) -> DataFrame:
    """``flows`` with the few hosts as a pushed filter; many are left to the join."""
    found = [r[0] for r in hosts.select(node).distinct().limit(PUSHED_HOSTS + 1).collect()]
    return flows.where(F.col(column).isin(found)) if len(found) <= PUSHED_HOSTS else flows


def callflow(
    flows: DataFrame, host: int, start: int, stop: int, transactions: DataFrame | None = None, max_hops: int | None = None,
    ip_dst: int | None = None, ip_proto: int | None = None, port_src: int | None = None, port_dst: int | None = None,
) -> DataFrame:
    """Rows of ``CALLFLOW`` that ``host`` may have set off in [start, stop[ (swapped if reversed).

    Each hop takes, for every host of its frontier and its time [t0, t1[:
    * ``flow``: the flows it sends that meet this time. Each distinct (peer, protocol, ports) is a contact, first met at the earliest
      of its flows, t0 at least;
    * ``back``: the flows from the peer to the host on swapped ports from the contact's first time on until t1. A contact lasts until
      the latest of these ends, t1 at most, and is but a moment if nothing came back;
    * transactions (``transactions``: kind, ip_clt, ip_srv, start, stop, request, response) that a peer serves within a contact with it, each
      once a hop.
    Times and volumes of flows are cut to the host's time in proportion. Peers that no hop has expanded make the next
    frontier, from the first to the last moment of their contacts; it goes on until there are none, or for ``max_hops``.
    ``ip_dst``, ``ip_proto`` and ports hold for the first host's flows only.

    Flows are staged once, dealt and sorted by source and time, so that a hop reads the row groups of its hosts and a busy host lies in many
    files. Contacts of a hop are staged tables, joined by host and bins of time; the hosts seen, one row each, are a staged
    table too. Only counts and the hosts of a small frontier reach the driver. Null addresses, ports or times match nothing;
    repeated flows all show; an empty table gives none.
    """
    spark = flows.sparkSession
    start, stop = min(start, stop), max(start, stop)
    inside = flows.select(*_FLOW).where((F.col("stop") >= start) & (F.col("start") < stop))
    inside = staged(inside.repartitionByRange("ip_src", "start").sortWithinPartitions("ip_src", "start"), "callflow-flows")
    if transactions is not None:
        transactions = transactions.select("kind", "ip_clt", "ip_srv", "start", "stop", "request", "response")
        transactions = transactions.where((F.col("start") >= start) & (F.col("start") < stop))
    frontier = spark.createDataFrame([(host, start, stop)], "node long, t0 long, t1 long")
    seen, out = frontier.select("node"), spark.createDataFrame([], CALLFLOW)
    columns = [x.split()[0] for x in CALLFLOW.split(", ")]

    def cut(rows: DataFrame, hop: int, kind: str) -> DataFrame:
        """Flows with the host's time (w0, w1) in the form of the result."""
        s, e, w0, w1 = (F.col(c) for c in ("start", "stop", "w0", "w1"))
        return rows.select(
            F.lit(hop).alias("hop"), F.lit(kind).alias("kind"), F.greatest(s, w0).alias("start"), F.least(e, w1).alias("stop"), *_FLOW[:5],
            *[portion(F.col(c), s, e, w0, w1).alias(c) for c in _FLOW[7:]], F.lit(None).cast("string").alias("request"), F.lit(None).cast("string").alias("response"),
        )

    for hop in itertools.count(1) if max_hops is None else range(1, max_hops + 1):
        hosts = small_side(frontier.select("node", "t0", "t1", F.col("t0").alias("w0"), F.col("t1").alias("w1")))
        sent = interval_join(_only(inside, frontier, "ip_src", "node"), hosts, {"ip_src": "node"}, start, stop)
        given = {"ip_dst": ip_dst, "ip_proto": ip_proto, "port_src": port_src, "port_dst": port_dst} if hop == 1 else {}
        for c, v in given.items():
            sent = sent if v is None else sent.where(F.col(c) == v)
        sent = staged(sent.select(*_FLOW, "w0", "w1"), "callflow-sent")
        keys = [F.col("ip_dst").alias("peer"), F.col("ip_src").alias("node"), F.col("ip_proto").alias("proto"), F.col("port_dst").alias("their"), F.col("port_src").alias("own")]
        contacts = sent.groupBy(*keys, "w0", "w1").agg(F.min(F.greatest("start", "w0")).alias("t0")).withColumn("t1", F.col("w1"))
        contacts = staged(contacts, "callflow-contacts")
        if contacts.isEmpty():
            break
        on = {"ip_src": "peer", "ip_dst": "node", "ip_proto": "proto", "port_src": "their", "port_dst": "own"}
        back = interval_join(_only(inside, contacts, "ip_src", "peer"), small_side(contacts), on, start, stop)
        back = staged(back.select(*_FLOW, "w0", "w1"), "callflow-back")
        out = out.unionByName(cut(sent, hop, "flow")).unionByName(cut(back, hop, "back"))
        last = back.groupBy(*[F.col(x).alias(y) for x, y in on.items()]).agg(F.max(F.least("stop", "w1")).alias("last"))
        names = ["peer", "node", "proto", "their", "own"]
        lasting = contacts.drop("t1").join(last, names, "left").withColumn("t1", F.greatest("t0", F.coalesce("last", "t0")))
        lasting = staged(lasting.select("peer", "t0", "t1"), "callflow-lasting")
        if transactions is not None:
            served = small_side(staged(merge_windows(lasting, ["peer"]), "callflow-served"))
            moments = transactions.withColumnRenamed("stop", "until").withColumn("stop", F.col("start"))
            found = interval_join(moments, served, {"ip_srv": "peer"}, start, stop)
            nothing = {c: F.lit(None).cast("int") for c in ("ip_proto", "port_src", "port_dst")} | {c: F.lit(None).cast("long") for c in ("packets", "payload")}
            found = found.withColumns({"hop": F.lit(hop), "stop": F.col("until"), "ip_src": F.col("ip_clt"), "ip_dst": F.col("ip_srv")} | nothing)
            out = out.unionByName(staged(found.select(*columns), "callflow-served"))
        frontier = lasting.groupBy(F.col("peer").alias("node")).agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
        frontier = staged(frontier.where("node IS NOT NULL").join(seen, "node", "left_anti"), "callflow-frontier")
        seen = staged(seen.unionByName(frontier.select("node")), "callflow-seen")
        if frontier.isEmpty():
            break
    return out.select(*columns)


def described(rows: DataFrame) -> DataFrame:
    """Rows of a call flow with ``label`` and ``grp``, as a reader sees them: ports and volume of a flow, the request of a transaction."""
    proto = labels.protocol(F.col("ip_proto"))
    ports = F.concat(labels.service(F.col("port_src")), F.lit("→"), labels.service(F.col("port_dst")))
    size = F.concat(F.lit(" ("), F.col("packets").cast("string"), F.when(F.col("packets") > 1, "pkts/").otherwise("pkt/"), numbers.volume(F.col("payload")), F.lit(")"))
    label = F.when(F.col("kind").isin("flow", "back"), F.concat(proto, F.lit("/"), ports, size)).otherwise(F.col("request"))
    grp = F.when(F.col("kind").isin("flow", "back"), labels.app_key(F.col("ip_proto"), F.least("port_src", "port_dst"))).otherwise(F.upper("kind"))
    shown = {"label": label, "grp": grp, "peer1": net.format_ip(F.col("ip_src")), "peer2": net.format_ip(F.col("ip_dst"))}
    return rows.withColumns(shown)
