"""Column helpers for conditions, casts and small derived values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def column_of(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def searched_case(branches: Iterable[tuple[Column, object]], default=None) -> Column:
    """``CASE WHEN``; the first true branch wins."""
    out = None
    for condition, value in branches:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    if out is None:
        raise ValueError("searched_case needs at least one branch")
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def derived_virtual_column(*cols: Column | str) -> Column:
    """Sum of columns in which a NULL counts as 0."""
    total = F.lit(0)
    for c in cols:
        total = total + F.coalesce(as_col(c), F.lit(0))
    return total


def null_safe_compare(a: Column | str, b: Column | str) -> Column:
    """``a IS DISTINCT FROM b``."""
    return ~as_col(a).eqNullSafe(as_col(b))


def try_cast_default(c: Column | str, data_type: str, default=None) -> Column:
    """Cast text, giving ``default`` where it cannot be read. A NULL input stays NULL."""
    c = as_col(c)
    fallback = default if isinstance(default, Column) else F.lit(default)
    cast = F.coalesce(c.try_cast(data_type), fallback.cast(data_type))
    return F.when(c.isNotNull(), cast)


def delta_flag(a: Column | str, b: Column | str, label: str, otherwise: str) -> Column:
    """``label`` where ``a - b`` is positive, else ``otherwise`` (also for NULL)."""
    return F.when(as_col(a) - as_col(b) > 0, F.lit(label)).otherwise(F.lit(otherwise))


def lag_or_zero(sent: Column | str, replayed: Column | str, ts: Column | str, as_of: Column) -> Column:
    """0 where both positions agree, otherwise the seconds from ``ts`` to ``as_of``."""
    seconds = micros_between(as_col(ts), as_of) / F.lit(1_000_000.0)
    return F.when(as_col(sent) == as_col(replayed), F.lit(0.0)).otherwise(seconds)


def position_diff(sent: Column | str, replayed: Column | str) -> Column:
    """Distance between two positions of the same log."""
    return as_col(sent) - as_col(replayed)


def micros_between(start: Column, end: Column, zoned: bool = False) -> Column:
    """Microseconds between two timestamps.

    Zone-less timestamps are subtracted, which no session time zone can shift. ``zoned`` is for
    instants, whose subtraction would follow the local clock over a change to summer time.
    """
    if zoned:
        return F.unix_micros(end) - F.unix_micros(start)
    seconds = (end - start).cast("interval second").cast("decimal(20,6)")
    return (seconds * 1_000_000).cast("bigint")


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 with the fraction kept, for a zone-less timestamp."""
    return micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), as_col(ts)) / F.lit(1_000_000.0)


def millis_to_timestamp(ms: Column | str) -> Column:
    """Epoch milliseconds to a zone-less timestamp."""
    return F.timestamp_add("MILLISECOND", as_col(ms), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
