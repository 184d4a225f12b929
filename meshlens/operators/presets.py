"""Preset filters of the metrics: optional conditions that are combined by AND.

Free conditions are Columns or Spark SQL texts (``where``); Spark parses and compiles them.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.functions import addresses, net


def _cidr(df: DataFrame, column: str, value: int | tuple[int, int] | str) -> Column:
    """``column`` is in ``value``: a number, (net, mask), or the text of an address or subnet of either family.

    On rows whose addresses are subnets themselves (``mask_clt`` beside ``ip_clt``) both must share an address.
    """
    mask = "mask" + column[2:]
    if not isinstance(value, str) and mask not in df.columns and df.schema[column].dataType.simpleString() == "bigint":
        n, m = (value, 32) if isinstance(value, int) else value
        return net.in_cidr(F.col(column), n, m)
    if not isinstance(value, str):
        n, m = (value, 32) if isinstance(value, int) else value
        value = f"{ipaddress.ip_address(n)}/{m}"
    own = F.col(column) if df.schema[column].dataType.simpleString() == addresses.ADDRESS else addresses.from_number(F.col(column))
    other, m = addresses.literal(value)
    return addresses.inter_cidr(own, F.col(mask), other, m) if mask in df.columns else addresses.in_cidr(own, other, m)


def _all(conditions: list[Column | None], where: Column | str | None) -> Column:
    given = [c for c in conditions if c is not None]
    if where is not None:
        given.append(F.expr(where) if isinstance(where, str) else where)
    return reduce(lambda a, b: a & b, given, F.lit(True))


def overlaps(start: int | None, stop: int | None, first: str = "start", last: str = "stop") -> Column:
    """Rows of the closed [first, last] that meet the half-open [start, stop[."""
    return _all([None if start is None else F.col(last) >= start, None if stop is None else F.col(first) < stop], None)


def _equal(**values) -> list[Column]:
    return [F.col(k).eqNullSafe(F.lit(v)) for k, v in values.items() if v is not None]


def traffic(
    df: DataFrame, start=None, stop=None, mac_src=None, mac_dst=None, eth_proto=None, ip_src=None, ip_dst=None, ip=None, ip_proto=None,
    port_src=None, port_dst=None, port=None, vlan=None, no_vlan=False, where=None,
) -> DataFrame:
    """Traffic and flow rows; ``ip`` and ``port`` match either side, addresses are numbers or (net, mask)."""
    either = [None if ip is None else _cidr(df, "ip_src", ip) | _cidr(df, "ip_dst", ip)]
    either.append(None if port is None else (F.col("port_src") == port) | (F.col("port_dst") == port))
    either += [None if x is None else _cidr(df, c, x) for c, x in (("ip_src", ip_src), ("ip_dst", ip_dst))]
    either.append(F.col("vlan").isNull() if no_vlan else None)
    equal = _equal(mac_src=mac_src, mac_dst=mac_dst, eth_proto=eth_proto, ip_proto=ip_proto, port_src=port_src, port_dst=port_dst, vlan=vlan)
    return df.where(_all([overlaps(start, stop), *either, *equal], where))


def transactions(
    df: DataFrame, start=None, stop=None, server=None, client=None, peer=None, error=None, qname=None, methd=None, status=None, host=None,
    url=None, rt_min=None, rt_max=None, tx_min=None, rt="rt_avg", count="rt_count", where=None, mac_clt=None, mac_srv=None, vlan=None, no_vlan=False,
) -> DataFrame:
    """Name-server, web and socket rows; names and hosts match by their end, urls by their beginning, clients that are subnets by a shared address."""
    tests = [overlaps(start, stop, "start", "start")]
    tests += [None if x is None else _cidr(df, c, x) for c, x in (("ip_srv", server), ("ip_clt", client))]
    tests.append(None if peer is None else _cidr(df, "ip_srv", peer) | _cidr(df, "ip_clt", peer))
    tests += [None if x is None else F.col(c).endswith(x) for c, x in (("name", qname), ("host", host))]
    tests.append(None if url is None else F.col("url").startswith(url))
    tests += [None if rt_min is None else F.col(rt) >= rt_min, None if rt_max is None else F.col(rt) <= rt_max]
    tests.append(None if tx_min is None else F.col(count) >= tx_min)
    tests.append(F.col("vlan").isNull() if no_vlan else None)
    return df.where(_all([*tests, *_equal(error=error, methd=methd, status=status, mac_clt=mac_clt, mac_srv=mac_srv, vlan=vlan)], where))


def with_virtual(df: DataFrame) -> DataFrame:
    """Name-server and web rows with their computed fields: ``queries``, how many a row stands for, and ``stop``, its start plus the longest response."""
    return df.withColumns({"queries": F.col("rt_count"), "stop": F.col("start") + F.floor(F.col("rt_max") * 1000).cast("long")})
