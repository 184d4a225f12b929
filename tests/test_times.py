"""Times as people write them, intervals, and numbers at the edge of a unit."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from meshlens.functions import numbers, times

NOW = int(datetime(2024, 3, 31, 14, 5, 6, tzinfo=UTC).timestamp()) * 1000 + 789


def at(*parts, ms=0):
    return int(datetime(*parts, tzinfo=UTC).timestamp()) * 1000 + ms


@pytest.mark.parametrize("text,want", [
    ("now", NOW), ("2012-10-25", at(2012, 10, 25)), ("2012/10/25 11:23", at(2012, 10, 25, 11, 23)), ("2012-10-25 11:23:02.3", at(2012, 10, 25, 11, 23, 2, ms=300)), ("2012-10", at(2012, 10, 1)),
    ("2012-10-25 11", at(2012, 10, 25, 11)), ("7:45", at(2024, 3, 31, 7, 45)), ("23:59:60", at(2024, 4, 1)), ("-1 month", at(2024, 2, 29, 14, 5, 6, ms=789)), ("2 hours", NOW + 7_200_000),
    ("1323766040s 992799us", 1323766040993), ("1323766040.5", 1323766040500), ("-1.5 days", NOW - 129_600_000),
])
def test_lenient_times(text, want):
    assert times.parse_time(text, NOW) == want


@pytest.mark.parametrize("text", ["", "yesterday", "2012-13-01", "2012-02-30", "25:00", "1969-01-01", "12:00:61", "2012-10-25T11:23"])
def test_no_times(text):
    with pytest.raises(ValueError):
        times.parse_time(text, NOW)


def test_zones_and_ranges():
    assert times.parse_time("2012-10-25", NOW, "Europe/Paris") == 1351116000000
    day = 86_400_000
    assert times.parse_range("2024-01-02", "2024-01-01", NOW) == (at(2024, 1, 1), at(2024, 1, 2))
    assert times.parse_range("2024-01-01", "2024-01-02", NOW, shift=-1) == (at(2024, 1, 1) - day, at(2024, 1, 1))
    assert times.parse_range("-1 day", "now", NOW, shift=1) == (NOW, NOW + day)


def test_intervals_compare_and_add(spark):
    i = times.Interval.parse
    assert i("1 day") < i("1 month") < i("1 year") and max(i("3 hours"), i("200 min")) == i("200 min")
    ts = F.timestamp_millis(F.lit(at(2024, 1, 31)))
    got = spark.range(1).select(F.unix_millis(i("1.5 months").after(ts)).alias("x")).first().x
    assert got == i("1.5 months").added_to(at(2024, 1, 31)) == at(2024, 2, 29) + times.UNIT_MS["month"] // 2


@pytest.mark.parametrize("value,want", [(999.9996, "1k"), (999.9994, "999.999"), (-999_999.9, "-1M"), (0.9999999, "1"), (1000.0, "1k")])
def test_units_follow_what_is_shown(spark, value, want):
    assert spark.range(1).select(numbers.number(F.lit(value)).alias("x")).first().x == want


def test_volumes_follow_what_is_shown(spark):
    assert spark.range(1).select(numbers.volume(F.lit(1023.999)).alias("x")).first().x == "1KiB"
