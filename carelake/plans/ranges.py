"""Bounds of written dates and numbers, and their comparison as columns."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta, timezone
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIXES = ("eq", "ne", "gt", "lt", "ge", "le", "sa", "eb", "ap")
_DATE = re.compile(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:T(\d\d):(\d\d)(?::(\d\d)(?:\.(\d+))?)?(Z|[+-]\d\d:\d\d)?)?)?)?")
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def split_prefix(text: str) -> tuple[str, str]:
    """A prefix counts only before a digit, a sign or a dot."""
    if len(text) > 2 and text[:2] in PREFIXES and text[2] in "0123456789+-.":
        return text[:2], text[2:]
    return "eq", text


def micros(t: datetime) -> int:
    return (t - _EPOCH) // timedelta(microseconds=1)


def date_bounds(text: str) -> tuple[int, int]:
    """The closed range of microseconds that a date of some precision covers; no zone means UTC."""
    m = _DATE.fullmatch(text.strip())
    if not m:
        raise ValueError(f"not a date: {text!r}")
    y, mo, d, h, mi, s, frac, zone = m.groups()
    tz = UTC if zone in (None, "Z") else timezone((1 if zone[0] == "+" else -1) * timedelta(hours=int(zone[1:3]), minutes=int(zone[4:])))
    low = datetime(int(y), int(mo or 1), int(d or 1), int(h or 0), int(mi or 0), int(s or 0), int((frac or "0").ljust(3, "0")[:3]) * 1000, tz)
    if mo is None:
        end = micros(low.replace(year=low.year + 1)) if low.year < 9999 else micros(low) + 366 * 86_400_000_000
    elif d is None:
        end = micros(low.replace(year=low.year + low.month // 12, month=low.month % 12 + 1)) if (low.year, low.month) != (9999, 12) else micros(low) + 31 * 86_400_000_000
    else:
        end = micros(low) + (86_400_000_000 if h is None else 60_000_000 if s is None else 1_000)
    return micros(low), end - 1


def number_bounds(text: str) -> tuple[float, float]:
    """Half a unit of the last written decimal on either side."""
    try:
        value = Decimal(text)
        if not value.is_finite():
            raise ValueError(f"not a number: {text!r}")
    except InvalidOperation:
        raise ValueError(f"not a number: {text!r}") from None
    half = Decimal(1).scaleb(min(0, value.as_tuple().exponent)) / 2
    return float(value - half), float(value + half)


def date_test(op: str, low: int, high: int) -> Column:
    a, b = F.col("low"), F.col("high")
    tests = {"ne": (a > high) | (b < low), "gt": b > high, "lt": a < low, "ge": b >= low, "le": a <= high, "sa": a > high, "eb": b < low}
    return tests.get(op, (a <= high) & (b >= low))


def number_test(op: str, low: float, high: float) -> Column:
    a, b = F.col("low"), F.col("high")
    tests = {"ne": (a >= high) | (b <= low), "gt": b > high, "lt": a < low, "ge": b >= low, "le": a <= high, "sa": a > high, "eb": b < low}
    return tests.get(op, (a < high) & (b > low))
