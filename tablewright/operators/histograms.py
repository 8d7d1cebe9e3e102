"""Histograms over numbers, dates and text lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.predicates import epoch_seconds, micros_between
from tablewright.functions.text import repeat_bar
from tablewright.operators.aggregates import bar_scaled_to_max
from tablewright.session import cut_lineage

# Step units as months, or as microseconds.
MONTHS = {"month": 1, "quarter": 3, "year": 12}
MICROS = {
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}
# Steps within which a series of months has met the shortest month it ever meets.
MONTH_CYCLE = 200


def _edges(df: DataFrame, value: Column) -> DataFrame:
    """One row with the lowest and highest value."""
    return df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))


def _number(df: DataFrame, col: str) -> Column:
    kind = df.schema[col].dataType.simpleString()
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return epoch_seconds(F.col(col).cast("timestamp_ntz"))
    return F.col(col).cast("double")


def equi_width_histogram(df: DataFrame, col: str, n: int, char: str = "=", rows_per_char: int = 1) -> DataFrame:
    """Count per bucket of equal width, most frequent first; the highest value lands in bucket n + 1.

    A bar has one character per ``rows_per_char`` rows.
    """
    value = _number(df, col)
    bucket = F.width_bucket(value, F.col("_lo"), F.col("_hi"), F.lit(n))
    counts = (
        df.crossJoin(F.broadcast(_edges(df, value)))
        .groupBy(bucket.alias("bucket"))
        .agg(F.count(col).alias("cnt"))
    )
    bar = repeat_bar(F.col("cnt") / F.lit(rows_per_char), char)
    return counts.withColumn("bar", bar).orderBy(F.col("cnt").desc(), "bucket")


def _step(step: str) -> tuple[str, int]:
    count, unit = step.split()
    unit = unit.rstrip("s")
    if unit in MONTHS:
        return "months", int(count) * MONTHS[unit]
    return "micros", int(count) * MICROS[unit]


def _series(df: DataFrame, value: Column, step: tuple[str, int]) -> DataFrame:
    """One row with the highest value and what tells every boundary of the series from the lowest on.

    Each boundary follows from the one before. Of months the day therefore never grows again: from
    the 31st it falls to 30, 29 or 28 with the first month that is that short, and stays there.
    ``_base`` holds the lowest value and the number of the first boundary with at most 30, 29 and 28
    days in its month.
    """
    kind, size = step
    edges = _edges(df, value)
    firsts = []
    for days in (30, 29, 28):
        number = F.lit(None).cast("bigint")
        if kind == "months":
            month = lambda k: F.add_months(F.trunc(F.col("_lo").cast("date"), "month"), (k * size).cast("int"))
            steps = F.sequence(F.lit(0).cast("bigint"), F.lit(MONTH_CYCLE).cast("bigint"))
            short = F.filter(steps, lambda k: F.dayofmonth(F.last_day(month(k))) <= days)  # noqa: B023
            number = F.get(short, F.lit(0))
        firsts.append(number.alias(f"to{days}"))
    return edges.select(F.struct(F.col("_lo").alias("lo"), *firsts).alias("_base"), "_hi")


def _boundary(base: Column, k: Column, step: tuple[str, int]) -> Column:
    """Boundary number k, from 0, of a series."""
    kind, size = step
    low = base["lo"]
    if kind != "months":
        return F.timestamp_add("MICROSECOND", k * F.lit(size), low)
    day = F.dayofmonth(low)
    for days in (30, 29, 28):
        day = F.when(base[f"to{days}"] <= k, F.least(day, F.lit(days))).otherwise(day)
    month = F.add_months(F.trunc(low.cast("date"), "month"), (k * size).cast("int"))
    clock = micros_between(F.date_trunc("day", low), low)
    return F.timestamp_add("MICROSECOND", clock, F.date_add(month, day - 1).cast("timestamp_ntz"))


def _bucket_number(value: Column, base: Column, step: tuple[str, int]) -> Column:
    """How many boundaries lie at or below the value. No list of boundaries is walked per row."""
    kind, size = step
    low = base["lo"]
    if kind == "months":
        # A month holds one boundary at most, so only the day within the month is left to compare.
        months = (F.year(value) - F.year(low)) * 12 + F.month(value) - F.month(low)
        k = F.floor(months / F.lit(size)).cast("bigint")
    else:
        k = F.floor(micros_between(low, value) / F.lit(size)).cast("bigint")
    return F.when(_boundary(base, k, step) > value, k).otherwise(k + 1)


def _with_range(df: DataFrame, step: tuple[str, int]) -> DataFrame:
    base, bucket = F.col("_base"), F.col("bucket")
    upper = _boundary(base, bucket, step)
    return df.withColumn("range_lower", _boundary(base, bucket - 1, step)).withColumn(
        "range_upper", F.when(upper <= F.col("_hi"), upper)
    )


def boundary_bucket(df: DataFrame, col: str, step: str) -> DataFrame:
    """Bucket number and half-open range of every row, by boundaries from the lowest value up.

    The last range has no upper end. ``step`` reads like ``6 months`` or ``1 day``.
    """
    spec = _step(step)
    value = F.col(col).cast("timestamp_ntz")
    rows = df.crossJoin(F.broadcast(_series(df, value, spec)))
    numbered = rows.withColumn("bucket", _bucket_number(value, F.col("_base"), spec))
    return _with_range(numbered, spec).drop("_base", "_hi")


def list_bucket(df: DataFrame, col: str, boundaries: Sequence) -> DataFrame:
    """``bucket``, how many of a free list of boundaries lie at or below the value; NULL for a NULL."""
    kind = df.schema[col].dataType
    bounds = F.array(*[F.lit(b).cast(kind) for b in sorted(boundaries)]) if boundaries else F.array().cast(f"array<{kind.simpleString()}>")
    below = F.size(F.filter(bounds, lambda b: b <= F.col(col))).cast("bigint")
    return df.withColumn("bucket", F.when(F.col(col).isNotNull(), below))


def calendar_histogram(df: DataFrame, col: str, step: str, char: str = "■", rows_per_char: int = 1) -> DataFrame:
    """Rows per calendar bucket: count, total, range, bar and percent. Empty buckets are absent.

    Ranges and bars are worked out after the grouping, once per bucket. A bar has one character per
    ``rows_per_char`` rows.
    """
    spec = _step(step)
    value = F.col(col).cast("timestamp_ntz")
    counts = (
        df.select(col)
        .crossJoin(F.broadcast(_series(df, value, spec)))
        .groupBy(_bucket_number(value, F.col("_base"), spec).alias("bucket"), "_base", "_hi")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    # The edges travel as constant keys, so that the total reads the very same shuffled counts.
    total = counts.agg(F.sum("cnt").alias("total_count"))
    percent = F.col("cnt").cast("double") * 100 / F.col("total_count")
    return (
        _with_range(counts.crossJoin(F.broadcast(total)), spec)
        .withColumn("bar", repeat_bar(F.col("cnt") / F.lit(rows_per_char), char))
        .withColumn("percent", percent)
        .withColumn("bar_percent", repeat_bar(percent, char))
        .drop("_base", "_hi")
        .orderBy("bucket")
    )


def length_histogram(df: DataFrame, text: str, n: int = 19, width: int = 50) -> DataFrame:
    """Text lengths in n buckets: range of lengths, count and a bar scaled to the largest bucket.

    The texts are read once, into a table of one row per length; the rest works on that.
    """
    lengths = cut_lineage(
        df.where(F.col(text).isNotNull()).groupBy(F.char_length(text).alias("_len")).agg(F.count(F.lit(1)).alias("_rows"))
    )
    bucket = F.width_bucket(
        F.col("_len").cast("double"), F.col("_lo").cast("double"), F.col("_hi").cast("double"), F.lit(n)
    )
    counts = (
        lengths.crossJoin(F.broadcast(_edges(lengths, F.col("_len"))))
        .groupBy(bucket.alias("bucket"))
        .agg(F.min("_len").alias("min_len"), F.max("_len").alias("max_len"), F.sum("_rows").alias("amount"))
    )
    return bar_scaled_to_max(counts, "amount", width).orderBy("bucket")
