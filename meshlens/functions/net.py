"""IPv4, subnet and MAC helpers on Columns. Addresses are unsigned 32-bit numbers in a bigint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ip(text: Column) -> Column:
    """Number of a dotted quad; null for anything else."""
    parts = [F.split_part(text, F.lit("."), F.lit(i + 1)).try_cast("long") for i in range(4)]
    ok = text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.greatest(*parts) <= 255)
    return F.when(ok, sum((F.shiftleft(x, 8 * (3 - i)) for i, x in enumerate(parts)), F.lit(0).cast("long")))


def format_ip(ip: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(ip, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)])


def in_cidr(ip: Column, net: int, mask: int) -> Column:
    """``ip`` is in ``net/mask``; host bits of ``net`` don't matter."""
    size = 1 << (32 - mask)
    low = net // size * size
    return ip.between(low, low + size - 1)


def in_cidr_columns(ip: Column, net: Column, mask: Column) -> Column:
    size = F.pow(F.lit(2), 32 - mask).cast("long")
    return F.floor(ip / size) == F.floor(net / size)


def inter_cidr(net: Column, mask: Column, other: int, other_mask: int) -> Column:
    """Two subnets share an address: the one with the shorter mask holds the other."""
    size = F.pow(F.lit(2), 32 - F.least(mask, F.lit(other_mask))).cast("long")
    return F.floor(net / size) == F.floor(F.lit(other) / size)


def subnet_size(mask: Column) -> Column:
    return F.pow(F.lit(2), 32 - mask).cast("long")


def addresses(net: Column, mask: Column) -> Column:
    """Array of all addresses of a subnet, for explode; meant for small subnets."""
    low = net - net % subnet_size(mask)
    return F.sequence(low, low + subnet_size(mask) - 1)


def blur(ip: Column, subnets: list[tuple[int, int]]) -> Column:
    """Text of the first configured subnet (net, mask) with ``ip``, else of the host itself."""
    names = [(in_cidr(ip, n, m), F.concat(format_ip(F.lit(n).cast("long")), F.lit(f"/{m}" if m < 32 else ""))) for n, m in subnets]
    return F.coalesce(*[F.when(c, name) for c, name in names], format_ip(ip))


def bucket(ip: Column, buckets: int) -> Column:
    """Hash bucket of an address, written at ingest and derived again from filters."""
    return F.pmod(ip, F.lit(buckets)).cast("int")


def mac(text: Column) -> Column:
    """Lower-case ``aa:bb:cc:dd:ee:ff``; null for anything else."""
    return F.when(F.lower(text).rlike("^[0-9a-f]{2}(:[0-9a-f]{2}){5}$"), F.lower(text))
