"""Numbers as text with scale suffixes, and back."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of numbers in texts.
SUFFIXES = {"G": 1e9, "M": 1e6, "K": 1024.0, "k": 1e3, "m": 1e-3, "u": 1e-6, "n": 1e-9}
UP, DOWN, VOLUMES = ["", "k", "M", "G", "T", "P"], ["", "m", "u", "n", "p"], ["", "KiB", "MiB", "GiB", "TiB", "PiB"]


def strip_zeros(text: Column) -> Column:
    """Without trailing zeros behind a point, and without a bare point."""
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def scaled(x: Column, base: float, up: list[str], down: list[str], digits: int) -> Column:
    """``x`` with the suffix that leaves a mantissa of 1 or more and below ``base``, as it is shown, where there is one."""
    size = F.abs(x.cast("double"))
    out = None
    steps = [(base**i, s) for i, s in enumerate(up)] + [(base**-i, s) for i, s in enumerate(down) if i]
    for factor, suffix in sorted(steps):
        text = F.concat(strip_zeros(F.format_string(f"%.{digits}f", x.cast("double") / factor)), F.lit(suffix))
        out = text if out is None else F.when(size >= factor - 0.5 * 10.0**-digits * factor / base, text).otherwise(out)
    return F.when(size == 0, "0").otherwise(out)


def number(x: Column) -> Column:
    return scaled(x, 1000.0, UP, DOWN, 3)


def volume(x: Column) -> Column:
    return scaled(x, 1024.0, VOLUMES, [], 2)


def min_max(low: Column, high: Column) -> Column:
    """Middle and half width of a range, or the value of an empty one."""
    return F.when(low == high, number(low)).otherwise(F.concat(number((low + high) / 2), F.lit(" ±"), number((high - low) / 2)))


def parse_number(text: Column) -> Column:
    """A float with an optional suffix; null for anything else."""
    suffix = F.regexp_extract(text, "([GMKkmun])$", 1)
    factor = F.lit(1.0)
    for k, v in SUFFIXES.items():
        factor = F.when(suffix == k, F.lit(v)).otherwise(factor)
    return F.regexp_replace(text, "[GMKkmun]$", "").try_cast("double") * factor


def grid_interval(width: float, n: int) -> float:
    """The largest tick step of 1, 2 or 5 times a power of ten that makes at least ``n`` steps in ``width``."""
    raw = width / n
    power = 10.0 ** math.floor(math.log10(raw))
    return next(m * power for m in (5.0, 2.0, 1.0) if m * power <= raw * (1 + 1e-12))


def grid(start: float, stop: float, n: int) -> list[float]:
    """Ticks within [start, stop]."""
    step = grid_interval(stop - start, n)
    first = math.ceil(start / step)
    return [i * step for i in range(first, math.floor(stop / step) + 1) if start <= i * step <= stop]
