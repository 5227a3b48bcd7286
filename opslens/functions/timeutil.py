"""Time helpers: literals, look-back windows, boundary counting.

Every operator takes ``as_of`` (a naive ``datetime``) and builds its window
bounds as *literals* on the raw timestamp column, so the predicate reaches the
parquet scan (``PushedFilters``) and partition pruning still applies.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts_lit(t: datetime | date) -> Column:
    """A ``timestamp_ntz`` literal (the driver data is timestamp_ntz)."""
    if not isinstance(t, datetime):
        t = datetime(t.year, t.month, t.day)
    return F.expr(f"TIMESTAMP_NTZ '{t:%Y-%m-%d %H:%M:%S}'")


def date_lit(t: datetime | date) -> Column:
    return F.expr(f"DATE '{t:%Y-%m-%d}'")


def midnight(as_of: datetime) -> datetime:
    """``CURRENT_DATE`` relative to ``as_of``."""
    return datetime(as_of.year, as_of.month, as_of.day)


def lookback(col: str | Column, as_of: datetime, days: float, *, floor_days: float = 0,
             end: datetime | None = None) -> Column:
    """``as_of - days <= col < as_of`` (FIL-1), or up to ``end`` where it is
    given (FIL-2 settled / FIL-3 complete-days windows). The upper bound makes a
    back-fill, a replay and a late run see what a run at ``as_of`` saw."""
    c = F.col(col) if isinstance(col, str) else col
    days = max(floor_days, days)
    return between_ts(c, as_of - timedelta(days=days), as_of if end is None else end)


def between_ts(col: str | Column, start: datetime, end: datetime) -> Column:
    """Half-open range ``start <= col < end`` (FIL-4)."""
    c = F.col(col) if isinstance(col, str) else col
    return (c >= ts_lit(start)) & (c < ts_lit(end))


def trunc(unit: str, col: str | Column) -> Column:
    """``date_trunc`` kept as ``timestamp_ntz``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def boundaries(unit: str, a: str | Column, b: str | Column) -> Column:
    """Number of ``unit`` boundaries crossed from ``a`` to ``b``.

    The warehouse dialect's ``DATEDIFF(unit, a, b)`` counts boundaries
    (00:59 -> 01:01 is one hour); Spark's ``timestampdiff`` counts whole
    elapsed units. Truncating both ends first gives the boundary count.
    """
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    u = unit.upper()
    if u == "DAY":
        return F.datediff(F.to_date(b), F.to_date(a)).cast("bigint")
    return F.timestamp_diff(u, trunc(unit.lower(), a), trunc(unit.lower(), b))


def seconds_between(a: str | Column, b: str | Column) -> Column:
    """Elapsed seconds ``b - a`` as double."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(1e6)


def dow0(col: str | Column) -> Column:
    """Day of week with 0 = Sunday (the warehouse dialect); Spark's is 1-based."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.dayofweek(c) - 1).cast("int")
