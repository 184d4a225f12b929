"""Labels of protocols, services, requests and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ethernet protocols, HTTP methods by code, IP protocols, well-known ports.
ETH_PROTOCOLS = {0x0800: "IPv4", 0x86DD: "IPv6", 0x0806: "ARP", 0x8100: "802.1q"}
METHODS = ["GET", "HEAD", "POST", "CONNECT", "PUT", "OPTIONS", "TRACE", "DELETE"]
IP_PROTOCOLS = {1: "icmp", 6: "tcp", 17: "udp"}
SERVICES = {22: "ssh", 25: "smtp", 53: "domain", 80: "http", 100: "newacct", 443: "https"}


def _case(x: Column, names: dict, other: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in reversed(names.items()):
        out = F.when(x == k, v).otherwise(out)
    return F.coalesce(out, other)


def eth_proto(x: Column) -> Column:
    return _case(x, ETH_PROTOCOLS, F.concat(F.lit("proto 0x"), F.lower(F.hex(x))))


def ip_key(proto: Column, ip_text: Column) -> Column:
    """The address where the protocol has addresses, else the protocol's label."""
    return F.when(proto.isin(0x0800, 0x86DD), ip_text).otherwise(eth_proto(proto))


def protocol(proto: Column) -> Column:
    return _case(proto, IP_PROTOCOLS, proto.cast("string"))


def service(port: Column) -> Column:
    return _case(port, SERVICES, port.cast("string"))


def app_key(proto: Column, port: Column) -> Column:
    return F.concat(protocol(proto), F.lit("/"), service(port))


def method(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, METHODS)), code), F.concat(F.lit("method "), code.cast("string")))


def request(code: Column, host: Column, url: Column, max_len: int) -> Column:
    """``VERB http://host/url``, cut to ``max_len`` with an ellipsis."""
    text = F.concat(method(code), F.lit(" http://"), host, url)
    return F.when(F.length(text) > max_len, F.concat(F.left(text, F.lit(max_len - 3)), F.lit("..."))).otherwise(text)


def error(code: Column, hidden: int) -> Column:
    """The code as text, empty for the one that means success."""
    return F.when(code == hidden, "").otherwise(code.cast("string"))


def shorten_url(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def url_name(host: Column, port: Column, url: Column) -> Column:
    return F.concat(host, F.when(port == 80, "").otherwise(F.concat(F.lit(":"), port.cast("string"))), url)


def vlan(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))
