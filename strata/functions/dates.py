"""Date functions with SQLite-like semantics."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from the Julian epoch to 2000-01-01 12:00.
J2000 = 2451545.0
JULIANDAY_SQL = "2451545.0D + (unix_micros(CAST(ts AS TIMESTAMP)) - 946728000000000) / 86400000000.0D"
UNIXEPOCH_SQL = "unix_seconds(CAST(ts AS TIMESTAMP))"

#: strftime specifiers and Spark's patterns for them; the others are computed.
_PATTERNS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "f": "ss.SSS"}


def julianday(ts: Column) -> Column:
    return F.lit(J2000) + (F.unix_micros(ts.cast("timestamp")) - F.lit(946728000000000)) / F.lit(86400000000.0)


def unixepoch(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def strftime(fmt: str, ts: Column, *modifiers: str) -> Column:
    """%Y %m %d %H %M %S %j %w %f %%, after the modifiers."""
    ts, parts, i = apply_modifiers(ts, *modifiers), [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            spec = fmt[i + 1]
            i += 2
            if spec == "%":
                parts.append(F.lit("%"))
            elif spec == "w":
                parts.append((F.dayofweek(ts) - 1).cast("string"))
            elif spec in _PATTERNS:
                parts.append(F.date_format(ts, _PATTERNS[spec]))
            else:
                raise ValueError(f"unknown specifier %{spec}")
        else:
            parts.append(F.lit(fmt[i]))
            i += 1
    return F.concat(*parts) if parts else F.lit("")


def apply_modifiers(ts: Column, *modifiers: str) -> Column:
    """'start of month|year|day' and '±N unit', left to right."""
    for m in modifiers:
        m = m.strip().lower()
        if start := re.fullmatch(r"start of (day|month|year)", m):
            ts = F.date_trunc(start[1], ts).cast("timestamp_ntz")
        elif shift := re.fullmatch(r"([+-]?\d+) (second|minute|hour|day|month|year)s?", m):
            ts = date_add(ts, int(shift[1]), shift[2])
        else:
            raise ValueError(f"unknown modifier {m!r}")
    return ts


def date_add(ts: Column, n: int | Column, unit: str) -> Column:
    """DATEADD for day, month, year, hour, minute and second."""
    n = n if isinstance(n, Column) else F.lit(n)
    unit = unit.lower().rstrip("s")
    places = {"year": 0, "month": 1, "day": 3, "hour": 4, "minute": 5, "second": 6}
    if unit not in places:
        raise ValueError(f"unknown unit {unit!r}")
    args = [F.lit(0)] * 7
    args[places[unit]] = n
    return ts + F.make_interval(*args)


def date_of(ts: Column) -> Column:
    return F.date_trunc("day", ts).cast("timestamp_ntz")
