import pytest
from pyspark.sql import functions as F

from meshlens.functions import labels, net, numbers, times


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("193.48.57.46", 3241163054), ("1.2.3.4", 16909060), ("256.1.1.1", None), ("host", None), (None, None)])
def test_parse_ip(spark, text, want):
    assert one(spark, net.parse_ip(F.lit(text).cast("string"))) == want


def test_cidr(spark):
    ip = F.lit(0xC0A80102).cast("long")
    assert one(spark, net.format_ip(ip)) == "192.168.1.2"
    assert all(one(spark, net.in_cidr(ip, *c)) for c in ((0xC0A80000, 16), (0xC0A80102, 16), (0xC0A80102, 32), (0, 0)))
    assert not one(spark, net.in_cidr(ip, 0xC0A80103, 32))
    assert one(spark, net.inter_cidr(F.lit(0xC0A80100).cast("long"), F.lit(24), 0xC0A80000, 16))
    assert one(spark, net.addresses(ip, F.lit(30))) == [0xC0A80100 + i for i in range(4)]
    assert one(spark, net.blur(ip, [(0xC0A80000, 16)])) == "192.168.0.0/16"


def test_times(spark):
    assert one(spark, times.parse_sniffed(F.lit("1323766040s 992799us"))) == 1323766040993
    assert one(spark, times.parse_sniffed(F.lit("1323766045s 962156us"))) == 1323766045962
    assert one(spark, times.format_millis(F.lit(1351156982300).cast("long"))) == "2012-10-25 09:23:02.300"
    assert one(spark, times.format_millis(F.lit(1351156980000).cast("long"))) == "2012-10-25 09:23"
    a, b = times.round_interval(F.lit(1000).cast("long"), F.lit(1000).cast("long"), 1000)
    assert (one(spark, a), one(spark, b)) == (1000, 2000)


def test_intervals():
    assert times.Interval.parse("6y 4months 42 secs") == times.Interval(76, 42_000)
    assert times.Interval.parse("42 ms").seconds == 0.042
    assert times.Interval.parse("1year -2 months").months == 10
    with pytest.raises(ValueError):
        times.Interval.parse("10 parsecs")
    assert times.fixed_step(86_400_000) == 432_000


@pytest.mark.parametrize("value,want", [(4000.0, "4k"), (0.004, "4m"), (-4000.0, "-4k"), (1500.0, "1.5k"), (1e7, "10M"), (0.0, "0")])
def test_numbers(spark, value, want):
    assert one(spark, numbers.number(F.lit(value))) == want


@pytest.mark.parametrize("text,want", [("42k", 42e3), ("42K", 43008), ("42M", 42e6), ("42G", 42e9), ("1.5k", 1500), ("-10.1e-1", -1.01), ("x", None)])
def test_parse_number(spark, text, want):
    assert one(spark, numbers.parse_number(F.lit(text))) == pytest.approx(want) if want is not None else one(spark, numbers.parse_number(F.lit(text))) is None


@pytest.mark.parametrize("width,n", [(1.0, 3), (0.37, 5), (12345.0, 7), (1e-6, 2)])
def test_ticks(width, n):
    assert 0 < numbers.grid_interval(width, n) <= width
    assert all(5.0 <= t <= 5.0 + width for t in numbers.grid(5.0, 5.0 + width, n))


def test_labels(spark):
    assert one(spark, labels.eth_proto(F.lit(0x0800))) == "IPv4"
    assert one(spark, labels.eth_proto(F.lit(0x88CC))) == "proto 0x88cc"
    assert one(spark, labels.request(F.lit(0), F.lit("h"), F.lit("/abcdef"), 12)) == "GET http:..."
