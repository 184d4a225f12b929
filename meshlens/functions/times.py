"""Times as milliseconds since 1970 in a bigint, intervals and rounding."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import UTC, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of a unit, months and years as averages.
UNIT_MS = {
    "year": 31_557_600_000, "month": 2_628_000_000, "week": 604_800_000, "day": 86_400_000, "hour": 3_600_000, "min": 60_000,
    "sec": 1000, "ms": 1,
}
_NAMES = {"y": "year", "months": "month", "w": "week", "d": "day", "h": "hour", "m": "min", "minute": "min", "s": "sec", "second": "sec", "msec": "ms"}


def millis(ts: str) -> Column:
    """Milliseconds of a timestamp column, cut to whole ones."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def div(a: Column, b: Column | int) -> Column:
    """Integer division towards zero."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def floor_to(ms: Column, step: int) -> Column:
    return ms - F.pmod(ms, F.lit(step))


def ceil_to(ms: Column, step: int) -> Column:
    return ms + F.pmod(-ms, F.lit(step))


def round_interval(start: Column, stop: Column, step: int) -> tuple[Column, Column]:
    """Start rounded down, stop rounded up, never empty."""
    low, high = floor_to(start, step), ceil_to(stop, step)
    return low, F.when(high == low, low + step).otherwise(high)


def parse_sniffed(text: Column) -> Column:
    """Milliseconds of ``1323766040s 992799us``, microseconds rounded."""
    seconds, micros = (F.regexp_extract(text, r"^(\d+)s (\d+)us$", i).try_cast("long") for i in (1, 2))
    return seconds * 1000 + F.floor((micros + 499) / 1000)


def format_millis(ms: Column) -> Column:
    """``YYYY-mm-dd HH:MM[:SS[.mmm]]`` in UTC."""
    ts = F.timestamp_millis(ms)
    head = F.date_format(ts, "yyyy-MM-dd HH:mm")
    seconds = F.when(F.pmod(ms, F.lit(1000)) != 0, F.date_format(ts, ":ss.SSS")).when(F.pmod(ms, F.lit(60_000)) != 0, F.date_format(ts, ":ss"))
    return F.concat(head, F.coalesce(seconds, F.lit("")))


@dataclass(frozen=True)
class Interval:
    """Months apart from milliseconds, as calendars need them."""

    months: float = 0.0
    ms: float = 0.0

    @classmethod
    def parse(cls, text: str) -> Interval:
        """``6y 4months 42 secs``, ``1year -2 months``, ``42 ms``."""
        found = re.findall(r"([+-]?\s*\d+(?:\.\d+)?)\s*([a-z]+)", text.lower())
        if not found or re.sub(r"([+-]?\s*\d+(?:\.\d+)?)\s*([a-z]+)|[\s,]", "", text.lower()):
            raise ValueError(f"not an interval: {text!r}")
        months = ms = 0.0
        for value, unit in found:
            n = float(value.replace(" ", ""))
            unit = _NAMES.get(unit) or (_NAMES.get(unit[:-1], unit[:-1]) if unit.endswith("s") and unit != "ms" else unit)
            if unit not in UNIT_MS:
                raise ValueError(f"unknown unit {unit!r} in {text!r}")
            if unit in ("year", "month"):
                months += n * (12 if unit == "year" else 1)
            else:
                ms += n * UNIT_MS[unit]
        return cls(months, ms)

    @property
    def seconds(self) -> float:
        years, months = divmod(self.months, 12)
        return (years * UNIT_MS["year"] + months * UNIT_MS["month"] + self.ms) / 1000

    def __neg__(self) -> Interval:
        return Interval(-self.months, -self.ms)

    def after(self, ts: Column) -> Column:
        """Calendar-aware ``ts`` plus this; a part of a month is that part of an average one."""
        whole = int(self.months)
        rest = self.ms + (self.months - whole) * UNIT_MS["month"]
        return ts + F.make_interval(months=F.lit(whole)) + F.make_dt_interval(secs=F.lit(rest / 1000))

    def __lt__(self, other: Interval) -> bool:
        """By length, months and years as averages."""
        return self.seconds < other.seconds

    def added_to(self, ms: int) -> int:
        """The same for a time in milliseconds, in UTC; a day beyond its month's end is its last."""
        at, whole = datetime.fromtimestamp(ms // 1000, UTC), int(self.months)
        year, month = divmod(at.year * 12 + at.month - 1 + whole, 12)
        day = min(at.day, calendar.monthrange(year, month + 1)[1])
        moved = at.replace(year=year, month=month + 1, day=day)
        return int(moved.timestamp()) * 1000 + ms % 1000 + round(self.ms + (self.months - whole) * UNIT_MS["month"])


_DATE = re.compile(r"(\d{4})[-/](\d{1,2})(?:[-/](\d{1,2})(?:\s+(\d{1,2})(?::(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?)?)?)?")
_CLOCK = re.compile(r"(\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?")


def moment(year: int, month: int = 1, day: int = 1, hour: int = 0, minute: int = 0, second: float = 0.0, zone: str = "UTC") -> int:
    """Milliseconds of a date and time of day, whose parts are checked; years are 1970 to 2100, a second of 60 is the next minute's first."""
    if not 1970 <= year <= 2100 or not 0 <= second <= 60:
        raise ValueError(f"no time: year {year}, second {second}")
    base = datetime(year, month, day, hour, minute, tzinfo=ZoneInfo(zone))
    return int(base.timestamp()) * 1000 + round(second * 1000)


def parse_time(text: str, now: int, zone: str = "UTC") -> int:
    """Milliseconds of a time as people write it, ``now`` being the time of the question.

    ``now``; a date with as much of a time of day as is given (a month alone too); a time of today; an interval such as ``-2 hours``, which counts from
    now; seconds and microseconds as packets have them; seconds since 1970. Anything else is a ValueError.
    """
    told = text.strip()
    if told.lower() == "now":
        return now
    if found := _DATE.fullmatch(told):
        parts = [int(x) for x in found.groups()[:5] if x is not None]
        return moment(*parts, **({"second": float(found[6])} if found[6] else {}), zone=zone)
    if found := _CLOCK.fullmatch(told):
        today = datetime.fromtimestamp(now // 1000, ZoneInfo(zone))
        return moment(today.year, today.month, today.day, int(found[1]), int(found[2]), float(found[3] or 0), zone)
    if found := re.fullmatch(r"(\d+)s (\d+)us", told):
        return int(found[1]) * 1000 + (int(found[2]) + 499) // 1000
    if re.fullmatch(r"[+-]?\d+(\.\d*)?", told):
        return int(float(told) * 1000)
    return Interval.parse(told).added_to(now)


def parse_range(start: str, stop: str, now: int, zone: str = "UTC", shift: int = 0) -> tuple[int, int]:
    """Both ends of a query's time, swapped if reversed, moved by ``shift`` times its length: -1 is the range before, 1 the one after."""
    a, b = sorted((parse_time(start, now, zone), parse_time(stop, now, zone)))
    return a + shift * (b - a), b + shift * (b - a)


def fixed_step(span_ms: int, wanted_ms: int | None = None) -> int:
    """Step of a series: a 200th of the span unless asked for, between a 1000th and a fifth of it."""
    step = wanted_ms or span_ms // 200
    return max(1, min(max(step, span_ms // 1000), span_ms // 5))


def time_unit(span_ms: int) -> tuple[str, int]:
    """Unit (name, milliseconds) to show rates over a span in."""
    return next(((n, UNIT_MS[n]) for n in ("week", "day", "hour") if span_ms > 2 * UNIT_MS[n]), ("min", UNIT_MS["min"]))
