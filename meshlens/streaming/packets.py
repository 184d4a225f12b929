"""Packets to transactions and sessions: one answer a query, socket openings, flows and traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlens.streaming.machines import Machine, over_stream, over_table

#: How long a web query, a name query and an opening socket wait, in milliseconds; how long a flow may pause and a traffic row last.
WEB_TIMEOUT, DNS_TIMEOUT, TCP_TIMEOUT = 60_000, 10_000, 80_000
FLOW_GAP, TRAFFIC_AGE = 500, 60_000


# One answer a query


class _FirstAnswer(Machine):
    """Queries wait for an answer; a state is a list of [us, number] of those that wait. ``n`` is the side, so that at one time queries come first."""

    fields = ["number"]
    output = "q_us long, q_n long, a_us long, a_n long"

    def __init__(self, timeout: int):
        self.timeout = timeout * 1000

    def step(self, state, row):
        us, side, number = row
        late = [q for q in state or [] if us - q[0] > self.timeout]
        waiting, out = (state or [])[len(late) :], self.close(late)
        if side:
            return None, out + [(*q, us, number) for q in waiting]
        return [*waiting, [us, number]], out

    def ends(self, state):
        return state[-1][0] + self.timeout

    def close(self, state):
        return [(*q, None, None) for q in state]


def _us(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def first_answers(queries: DataFrame, answers: DataFrame, keys: list[str], timeout: int, ts: str = "ts", n: str = "n", keep_unanswered: bool = False) -> DataFrame:
    """(keys, q_n, ts, a_n, rt, timed_out): each query with its first answer to the same keys, at its time or up to ``timeout`` ms later.

    ``n`` numbers queries and answers; of answers at the same time the smallest is first. One answer may serve several queries that wait.
    ``rt`` is in seconds; with ``keep_unanswered`` queries without an answer come too, with ``rt`` 0 and ``timed_out``.

    The union of both sides is sorted by time once, newest first, and each query takes the answer last seen: linear, however many
    queries and answers a key has. Time is cut into bins of ``timeout``; an answer goes to its own and the bin before, so a busy key is
    spread over its bins. Null keys or times of a query stay unanswered, those of an answer match nothing; repeated queries all show.
    """
    us, bin_ = F.col("_us"), F.floor(F.col("_us") / (timeout * 1000))
    null = F.lit(None).cast("long")
    q = queries.select(*keys, ts, F.col(n).cast("long").alias("q_n"), _us(ts).alias("_us"))
    q = q.select(*keys, ts, "q_n", "_us", F.lit(0).alias("_side"), null.alias("_n"), bin_.alias("_bin"))
    a = answers.dropna(subset=[*keys, ts]).select(*keys, F.col(n).cast("long").alias("_n"), _us(ts).alias("_us"))
    a = a.select(*keys, F.lit(None).cast(q.schema[ts].dataType).alias(ts), null.alias("q_n"), "_us", F.lit(1).alias("_side"), "_n", F.explode(F.array(bin_ - 1, bin_)).alias("_bin"))
    newest = Window.partitionBy(*keys, "_bin").orderBy(F.desc("_us"), F.desc("_side"), F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_side") == 1, F.struct("_us", "_n")), ignorenulls=True).over(newest)
    rows = q.unionByName(a).withColumn("_a", seen).where("_side = 0")
    hit = F.coalesce(F.col("_a._us") - us <= timeout * 1000, F.lit(False))
    out = rows.select(
        *keys, "q_n", ts, F.when(hit, F.col("_a._n")).alias("a_n"), F.when(hit, (F.col("_a._us") - us) / 1e6).otherwise(0.0).alias("rt"), (~hit).alias("timed_out")
    )
    return out if keep_unanswered else out.where("NOT timed_out")


def first_answers_stream(queries: DataFrame, answers: DataFrame, keys: list[str], timeout: int, delay: str, ts: str = "ts", n: str = "n", keep_unanswered: bool = False) -> DataFrame:
    """The same over two streams; queries without an answer come out once the watermark has passed their time."""
    sides = [x.select(*keys, F.col(ts).alias("_t"), _us(ts).alias("us"), F.col(n).alias("number"), F.lit(i).alias("n")) for i, x in enumerate((queries, answers))]
    found = over_stream(sides[0].unionByName(sides[1]), keys, _FirstAnswer(timeout), "_t", delay)
    hit = F.col("a_us").isNotNull()
    out = found.select(*keys, "q_n", F.timestamp_micros("q_us").alias(ts), "a_n", F.when(hit, (F.col("a_us") - F.col("q_us")) / 1e6).otherwise(0.0).alias("rt"), (~hit).alias("timed_out"))
    return out if keep_unanswered else out.where("NOT timed_out")


# Sockets


class _Opening(Machine):
    """A socket between its first SYN and the acknowledgement of who sent it: [side, us, syns]."""

    fields = ["side", "syn", "ack"]
    output = "side int, us long, syns long, ct double, timed_out boolean"

    def __init__(self, timeout: int):
        self.timeout = timeout * 1000

    def step(self, state, row):
        us, _, side, syn, ack = row
        out = []
        if state and us > state[1] + self.timeout:
            out, state = self.close(state), None
        if state and ack and side == state[0]:
            return None, [*out, (state[0], state[1], state[2], (us - state[1]) / 1e6, False)]
        if syn:
            state = [state[0], state[1], state[2] + 1] if state else [side, us, 1]
        return state, out

    def ends(self, state):
        return state[1] + self.timeout

    def close(self, state):
        return [(state[0], state[1], state[2], 0.0, True)]


def _ends(packets: DataFrame) -> tuple[DataFrame, list[str]]:
    """Packets by the two ends of their conversation, whatever their direction; ``side`` 1 goes from the greater end to the lesser."""
    src, dst = F.struct("ip_src", "port_src"), F.struct(F.col("ip_dst").alias("ip_src"), F.col("port_dst").alias("port_src"))
    up = src <= dst
    ends = {"low_ip": ("ip_src", "ip_dst"), "low_port": ("port_src", "port_dst"), "high_ip": ("ip_dst", "ip_src"), "high_port": ("port_dst", "port_src")}
    rows = packets.withColumns({k: F.when(up, F.col(a)).otherwise(F.col(b)) for k, (a, b) in ends.items()} | {"side": (~up).cast("int"), "us": _us("ts")})
    return rows.drop("ip_src", "ip_dst", "port_src", "port_dst"), list(ends)


def _client(rows: DataFrame) -> list[Column]:
    """Client and server of a result by the side that spoke first."""
    low = F.col("side") == 0
    pairs = {"ip_clt": ("low_ip", "high_ip"), "port_clt": ("low_port", "high_port"), "ip_srv": ("high_ip", "low_ip"), "port_srv": ("high_port", "low_port")}
    return [F.when(low, F.col(a)).otherwise(F.col(b)).alias(k) for k, (a, b) in pairs.items()]


def sockets(packets: DataFrame, timeout: int = TCP_TIMEOUT, delay: str | None = None) -> DataFrame:
    """(ip_clt, port_clt, ip_srv, port_srv, ts, syns, ct, timed_out) of socket packets (ts, n, ip_src, port_src, ip_dst, port_dst, syn, ack).

    A socket begins with a SYN; further SYNs of either end are counted; the first packet with ACK of the end that began opens it, ``ct`` seconds later.
    One that isn't open within ``timeout`` ms comes out with ``ct`` 0 and ``timed_out``. For a stream give ``delay``; a table's last sockets time out at its end.
    """
    rows, keys = _ends(packets)
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("syn", "ack")})
    machine = _Opening(timeout)
    found = over_table(rows, keys, machine) if delay is None else over_stream(rows, keys, machine, "ts", delay)
    return found.select(*_client(found), F.timestamp_micros("us").alias("ts"), "syns", "ct", "timed_out")


# Flows


class _Flow(Machine):
    """Payload in one direction: [side, first, last, packets, payload]."""

    fields = ["side", "payload"]
    output = "side int, us long, last long, packets long, payload long"

    def __init__(self, gap: int):
        self.gap = gap * 1000

    def step(self, state, row):
        us, _, side, payload = row
        if state and side == state[0] and us - state[2] <= self.gap:
            return [side, state[1], us, state[3] + 1, state[4] + payload], []
        return [side, us, us, 1, payload], self.close(state) if state else []

    def ends(self, state):
        return state[2] + self.gap

    def close(self, state):
        return [tuple(state)]


def flows(packets: DataFrame, gap: int = FLOW_GAP, delay: str | None = None) -> DataFrame:
    """(ip_proto, ip_src, port_src, ip_dst, port_dst, start, stop, packets, payload) of packets (ts, n, addresses, ports, ip_proto, payload).

    A flow is payload in one direction; a pause of more than ``gap`` ms ends it, and so does payload the other way. Packets without payload
    do neither. Over a table, cuts are found where the direction or the pause changes and numbered by a running sum; for a stream give ``delay``.
    """
    rows, ends = _ends(packets.where("payload > 0"))
    keys = ["ip_proto", *ends]
    if delay is None:
        order = Window.partitionBy(*keys).orderBy("us", "n")
        same = (F.lag("side").over(order) == F.col("side")) & (F.col("us") - F.lag("us").over(order) <= gap * 1000)
        cut = rows.where("us IS NOT NULL").withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_flow", F.sum("_new").over(order))
        sums = [F.min("us").alias("us"), F.max("us").alias("last"), F.count("*").alias("packets"), F.sum("payload").cast("long").alias("payload")]
        found = cut.groupBy(*keys, "side", "_flow").agg(*sums)
    else:
        found = over_stream(rows, keys, _Flow(gap), "ts", delay)
    ip_src, port_src, ip_dst, port_dst = (c.alias(n) for c, n in zip(_client(found), ("ip_src", "port_src", "ip_dst", "port_dst")))
    return found.select("ip_proto", ip_src, port_src, ip_dst, port_dst, F.timestamp_micros("us").alias("start"), F.timestamp_micros("last").alias("stop"), "packets", "payload")


# Traffic

_LAYERS = ["mac_src", "mac_dst", "eth_proto", "ip_src", "ip_dst", "ip_proto", "port_src", "port_dst"]


class _Traffic(Machine):
    """Packets of a key for so long after the first: [first, last, packets, eth_payload, mtu, ip_payload, l4_payload]."""

    fields = ["eth_payload", "ip_payload", "l4_payload"]
    output = "us long, last long, packets long, eth_payload long, mtu long, ip_payload long, l4_payload long"

    def __init__(self, age: int):
        self.age = age * 1000

    def step(self, state, row):
        us, _, eth, ip, l4 = row
        if state and us - state[0] <= self.age:
            return [state[0], us, state[2] + 1, state[3] + eth, max(state[4], eth), state[5] + ip, state[6] + l4], []
        return [us, us, 1, eth, eth, ip, l4], self.close(state) if state else []

    def ends(self, state):
        return state[0] + self.age

    def close(self, state):
        return [tuple(state)]


def traffic(packets: DataFrame, age: int = TRAFFIC_AGE, delay: str | None = None) -> DataFrame:
    """Traffic rows of packets: sums by the most specific layer each packet has, closed when older than ``age`` ms.

    Socket and datagram packets (protocols 6 and 17) go by addresses and ports, others with addresses by these and the protocol, the rest by hardware
    addresses and protocol; what a layer lacks is null in the key and 0 in the sums. For a stream give ``delay``.
    """
    has_ip = F.col("ip_src").isNotNull() & F.col("ip_dst").isNotNull()
    has_ports = has_ip & F.coalesce(F.col("ip_proto").isin(6, 17), F.lit(False))
    rows = packets.withColumn("us", _us("ts"))
    rows = rows.withColumns({c: F.when(has_ports, F.col(c)) for c in ("port_src", "port_dst")} | {"l4_payload": F.when(has_ports, F.coalesce("l4_payload", F.lit(0))).otherwise(0)})
    rows = rows.withColumn("ip_proto", F.when(has_ip, F.col("ip_proto"))).withColumn("ip_payload", F.when(has_ip, F.coalesce("ip_payload", F.lit(0))).otherwise(0))
    rows = rows.withColumn("eth_payload", F.coalesce("eth_payload", F.lit(0)))
    machine = _Traffic(age)
    found = over_table(rows, _LAYERS, machine) if delay is None else over_stream(rows, _LAYERS, machine, "ts", delay)
    return found.select(*_LAYERS, F.timestamp_micros("us").alias("start"), F.timestamp_micros("last").alias("stop"), "packets", "eth_payload", "mtu", "ip_payload", "l4_payload")
