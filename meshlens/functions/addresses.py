"""IPv4 and IPv6 addresses as 16 bytes in a column: struct(family, hi, lo), and joins with subnets by prefix.

``hi`` and ``lo`` are the first and last eight bytes as signed longs; an IPv4 address is the first four bytes, so a mask of any length is
the same two operations on longs for both. Addresses of different families are never in each other's subnets.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.sources.staging import BROADCAST_ROWS

ADDRESS = "struct<family:int,hi:bigint,lo:bigint>"
#: Subnets of more addresses than this aren't spelled out.
MOST_ADDRESSES = 1 << 16


def _of(family: Column | int, hi: Column, lo: Column | int) -> Column:
    f, low = (F.lit(x) if isinstance(x, int) else x for x in (family, lo))
    return F.struct(f.cast("int").alias("family"), hi.cast("long").alias("hi"), low.cast("long").alias("lo"))


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def literal(text: str) -> tuple[Column, int]:
    """Address and mask of ``a.b.c.d``, ``x::y`` or either with ``/mask``, without one that of a single host; host bits are kept."""
    at = ipaddress.ip_interface(text)
    n = int(at.ip) << (128 - at.max_prefixlen)
    return _of(at.version, F.lit(_signed(n >> 64)), F.lit(_signed(n & (1 << 64) - 1))), at.network.prefixlen


def from_number(ip: Column) -> Column:
    """IPv4 address of an unsigned 32-bit number in a bigint; null for anything else."""
    return F.when(ip.between(0, (1 << 32) - 1), _of(4, F.shiftleft(ip.cast("long"), 32), 0))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _longs(digits: Column, *starts: int) -> list[Column]:
    return [F.conv(F.substring(digits, i, 16), 16, -10).cast("long") for i in starts]


def parse(text: Column) -> Column:
    """Address of a dotted quad or of any form of an IPv6 address, a dotted quad as its end too; null for anything else."""
    quad = r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    bytes_ = F.transform(F.split(F.regexp_extract(text, quad, 0), r"\."), lambda x: x.try_cast("int"))
    hexed = F.when(F.forall(bytes_, lambda x: x <= 255), F.array_join(F.transform(bytes_, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    four = F.when(text.rlike("^" + quad), _let(hexed, lambda h: F.when(h.isNotNull(), _of(4, *_longs(F.rpad(h, 16, "0"), 1), 0))))
    tailed = _let(hexed, lambda h: F.concat(F.regexp_replace(text, quad, ""), F.left(h, F.lit(4)), F.lit(":"), F.right(h, F.lit(4))))
    plain = F.lower(F.when(~text.contains("."), text).when(text.rlike(":" + quad), tailed))
    groups = lambda half: F.filter(F.split(half, ":", -1), lambda g: g != "")

    def put(halves: Column, left: Column, right: Column) -> Column:
        """A gap stands for one group at least; without one there are eight."""
        missing = 8 - F.size(left) - F.size(right)
        fine = F.when(F.size(halves) == 2, missing >= 1).otherwise((F.size(halves) == 1) & (missing == 0))
        whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        digits = F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")
        return F.when(fine, _let(digits, lambda d: _of(6, *_longs(d, 1, 17))))

    def six(p: Column) -> Column:
        """No group is empty or longer than four digits."""
        right = lambda h: groups(F.coalesce(F.get(h, F.lit(1)), F.lit("")))
        found = _let(F.split(p, "::", 3), lambda h: _let(groups(h[0]), lambda x: _let(right(h), lambda y: put(h, x, y))))
        return F.when(p.rlike("^[0-9a-f:]+$") & ~p.rlike(":::|^:[^:]|[^:]:$|[0-9a-f]{5}"), found)

    return F.when(text.contains(":"), _let(plain, six)).otherwise(four)


def to_number(address: Column) -> Column:
    """Unsigned 32-bit number of an IPv4 address in a bigint; null for others."""
    return F.when(address["family"] == 4, F.shiftrightunsigned(address["hi"], 32))


def display(address: Column) -> Column:
    """Dotted quad, or the shortest usual form of an IPv6 address: the first longest run of two or more zero groups is ``::``."""
    quad = F.concat_ws(".", *[F.shiftright(address["hi"], s).bitwiseAND(F.lit(255)).cast("string") for s in (56, 48, 40, 32)])
    groups = [F.lower(F.hex(F.shiftright(address[half], s).bitwiseAND(F.lit(0xFFFF)))) for half in ("hi", "lo") for s in (48, 32, 16, 0)]
    six = F.concat(F.lit(":"), F.concat_ws(":", *groups), F.lit(":"))
    short = six
    for n in range(2, 9):  # the last that holds is the longest
        zeros = ":0" * n + ":"
        at = F.instr(six, zeros)
        cut = F.concat(F.left(six, at - 1), F.lit("::"), F.substring(six, at + len(zeros), F.length(six)))
        short = F.when(at > 0, cut).otherwise(short)
    short = F.regexp_replace(F.regexp_replace(short, "^:(?!:)", ""), "(?<!:):$", "")
    return F.when(address["family"] == 4, quad).when(address["family"] == 6, short)


def width(address: Column) -> Column:
    """Bits of an address."""
    return F.when(address["family"] == 4, 32).otherwise(128)


def _upper_bits(n: Column) -> Column:
    """A long whose first ``n`` bits are set."""
    kept = F.least(F.greatest(n, F.lit(0)), F.lit(64))
    return F.when(kept == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), (64 - kept).cast("int")))


def masked(address: Column, mask: Column | int) -> Column:
    """The address with all but its first ``mask`` bits cleared."""
    m = F.lit(mask) if isinstance(mask, int) else mask
    return F.when(address.isNotNull(), _of(address["family"], address["hi"].bitwiseAND(_upper_bits(m)), address["lo"].bitwiseAND(_upper_bits(m - 64))))


def in_cidr(address: Column, net: Column, mask: Column | int) -> Column:
    return masked(address, mask) == masked(net, mask)


def inter_cidr(net: Column, mask: Column | int, other: Column, other_mask: Column | int) -> Column:
    """Two subnets share an address: they are equal up to the shorter mask."""
    a, b = (F.lit(m) if isinstance(m, int) else m for m in (mask, other_mask))
    shorter = F.least(a, b)
    return masked(net, shorter) == masked(other, shorter)


def subnet_size(net: Column, mask: Column) -> Column:
    return F.pow(F.lit(2.0), width(net) - mask)


def spelled_out(net: Column, mask: Column) -> Column:
    """Array of all addresses of a subnet, for explode; null for subnets of over ``MOST_ADDRESSES``."""
    low = masked(net, mask)
    last = F.sequence(F.lit(0).cast("long"), (subnet_size(net, mask) - 1).cast("long"))
    each = F.transform(last, lambda i: F.when(low["family"] == 4, _of(4, low["hi"] + F.shiftleft(i, 32), 0)).otherwise(_of(6, low["hi"], low["lo"] + i)))
    return F.when(subnet_size(net, mask) <= MOST_ADDRESSES, each)


def subnet_table(spark: SparkSession, subnets: list[str]) -> DataFrame:
    """(rank, net, mask) of subnets in the order of their preference."""
    rows = []
    for i, text in enumerate(subnets):
        at = ipaddress.ip_network(text, strict=False)
        n = int(at.network_address) << (128 - at.max_prefixlen)
        rows.append((i, (at.version, _signed(n >> 64), _signed(n & (1 << 64) - 1)), at.prefixlen))
    return spark.createDataFrame(rows, f"rank long, net {ADDRESS}, mask int")


def subnet_of(rows: DataFrame, address: str, subnets: DataFrame, net: str = "net", mask: str = "mask", rank: str | None = None) -> DataFrame:
    """``rows`` with the subnet (``net``, ``mask``) of ``address``: the first by rank that holds it, else the host by itself.

    ``subnets`` has rank, net and mask; of equal ones the first counts, masks beyond a family's width none. There is one equality join for each length that occurs,
    on the prefix of that length, and the least rank of the matches is kept, so the work doesn't grow with the number of subnets. They are
    broadcast up to a counted number and shuffled beyond. A null address has no subnet; no row is lost or doubled.
    """
    known = subnets.where((F.col("mask") >= 0) & (F.col("mask") <= width(F.col("net"))))
    known = known.groupBy(masked(F.col("net"), F.col("mask")).alias("_net"), F.col("mask").alias("_mask")).agg(F.min("rank").alias("_rank"))
    lengths = sorted(r[0] for r in known.select("_mask").distinct().collect())  # 129 at most
    small = known.count() <= BROADCAST_ROWS
    out, ranks = rows, []
    for m in lengths:
        side = known.where(F.col("_mask") == m).select(F.col("_net").alias("_n"), F.struct(F.col("_rank").alias("rank"), F.lit(m).alias("mask")).alias(f"_r{m}"))
        out = out.join(F.broadcast(side) if small else side, masked(F.col(address), m) == F.col("_n"), "left").drop("_n")
        ranks.append(F.col(f"_r{m}"))
    best = F.array_min(F.array(*ranks)) if ranks else F.lit(None).cast("struct<rank:bigint,mask:int>")
    found = out.withColumn("_best", best).drop(*[f"_r{m}" for m in lengths])
    own = F.coalesce(F.col("_best.mask"), F.when(F.col(address).isNotNull(), width(F.col(address))))
    found = found.withColumns({mask: own} | ({rank: F.col("_best.rank")} if rank else {}))
    return found.withColumn(net, masked(F.col(address), F.col(mask))).drop("_best")
