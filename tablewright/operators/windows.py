"""Operators over ordered rows: gaps, tails, row numbers and overlapping periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.predicates import micros_between
from tablewright.functions.text import format_interval
from tablewright.operators.ordered import (
    SLICE,
    as_list,
    carry_window,
    join_slices,
    numbered,
    slice_window,
    with_slices,
)


ROW_LIMIT = 1_000


def _with_gap(df: DataFrame, ts: str) -> DataFrame:
    zoned = isinstance(df.schema[ts].dataType, T.TimestampType)
    gap = F.floor(micros_between(F.col("prev_time"), F.col(ts), zoned) / F.lit(1000)).cast("bigint")
    return df.withColumn("gap_ms", gap).withColumn("gap", format_interval("gap_ms"))


def log_gap(
    df: DataFrame, ts: str, tie: str, partition: str | Sequence[str] | None = None, slices: int | None = None
) -> DataFrame:
    """Number the messages of each key (or of the whole log) and give the time since the one before."""
    keys, order = as_list(partition), [ts, tie]
    sliced, cut = with_slices(df, order, slices, keys)
    within = slice_window(keys, order)
    body = sliced.withColumn("rn", F.row_number().over(within).cast("bigint")).withColumn("prev_time", F.lag(ts).over(within))
    if not cut:
        return _with_gap(body.drop(SLICE), ts)
    across = carry_window(keys)
    ends = (
        sliced.groupBy(*keys, SLICE)
        .agg(F.count(F.lit(1)).alias("_rows"), F.max(ts).alias("_last"))
        .select(
            *keys,
            SLICE,
            F.lag("_last").over(across).alias("_before"),
            F.sum("_rows").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_skipped"),
        )
    )
    joined = join_slices(body, ends, keys)
    out = joined.withColumn("prev_time", F.when(F.col("rn") == 1, F.col("_before")).otherwise(F.col("prev_time")))
    out = out.withColumn("rn", F.col("rn") + F.coalesce(F.col("_skipped"), F.lit(0)))
    return _with_gap(out.drop("_before", "_skipped", SLICE), ts)


def log_tail(
    df: DataFrame,
    ts: str,
    tie: str,
    n: int = 20,
    partition: str | Sequence[str] | None = None,
    from_row: int = 1,
) -> DataFrame:
    """The last n messages with their gaps, those below ``from_row`` left out.

    Only n + 1 rows per key pass the shuffle: the extra one is the predecessor of the first shown.
    Spark cuts groups that early up to 1,000 rows; a longer tail is taken from the whole log.
    """
    keys = as_list(partition)
    if keys and n >= ROW_LIMIT:
        numbers = log_gap(df, ts, tie, keys)
        totals = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_total"))
        same = F.lit(True)
        for k in keys:
            same = same & numbers[k].eqNullSafe(totals[f"_k_{k}"])
        shown = (F.col("rn") > F.col("_total") - n) & (F.col("rn") >= from_row)
        return numbers.join(totals, same, "inner").where(shown).drop("_total", *[f"_k_{k}" for k in keys])
    newest = [F.col(ts).desc(), F.col(tie).desc()]
    if keys:
        ranked = df.withColumn("_back", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest)))
        kept = ranked.where(F.col("_back") <= n + 1)
        totals = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_total"))
        on = F.lit(True)
        for k in keys:
            on = on & kept[k].eqNullSafe(totals[f"_k_{k}"])
        kept = kept.join(totals, on, "inner").drop(*[f"_k_{k}" for k in keys])
    else:
        last = df.orderBy(*newest).limit(n + 1)
        ranked = last.withColumn("_back", F.row_number().over(Window.orderBy(*newest)))
        kept = ranked.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_total"))))
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts, tie))
    out = (
        kept.withColumn("prev_time", before)
        .withColumn("rn", (F.col("_total") - F.col("_back") + 1).cast("bigint"))
        .where((F.col("_back") <= n) & (F.col("rn") >= from_row))
        .drop("_back", "_total")
    )
    return _with_gap(out, ts)


def row_number_plain(
    df: DataFrame,
    order: Sequence[str],
    partition: str | Sequence[str] | None = None,
    slices: int | None = None,
) -> DataFrame:
    return numbered(df, order, partition, "rn", slices)


def overlapping_periods(
    df: DataFrame, key: str | Sequence[str], id_col: str, lower: str, upper: str, slices: int | None = None
) -> DataFrame:
    """Rows whose half-open period overlaps one of another row with the same key.

    In order of the lower bound a period overlaps when one before it ends after its start, or the
    next one starts before its end. A NULL bound is infinite: bounds are compared as (side, value),
    in the type of their column. Empty periods overlap nothing and are left aside.
    """
    keys = as_list(key)
    low_side = F.when(F.col(lower).isNull(), 0).otherwise(1)
    high_side = F.when(F.col(upper).isNull(), 2).otherwise(1)
    rows = (
        df.withColumn("_side", low_side)
        .withColumn("_lo", F.struct(low_side.alias("side"), F.col(lower).alias("v")))
        .withColumn("_hi", F.struct(high_side.alias("side"), F.col(upper).alias("v")))
        .where("_lo < _hi")
    )
    order = ["_side", lower, id_col]
    sliced, cut = with_slices(rows, order, slices, keys)
    within = slice_window(keys, order)
    body = sliced.withColumn(
        "_max_before", F.max("_hi").over(within.rowsBetween(Window.unboundedPreceding, -1))
    ).withColumn("_next", F.lead("_lo").over(within))
    if cut:
        across = carry_window(keys)
        ends = (
            sliced.groupBy(*keys, SLICE)
            .agg(F.max("_hi").alias("_slice_hi"), F.min("_lo").alias("_slice_lo"))
            .select(
                *keys,
                SLICE,
                F.max("_slice_hi").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_hi_carried"),
                F.lead("_slice_lo").over(across).alias("_lo_after"),
            )
        )
        body = join_slices(body, ends, keys)
        body = body.withColumn("_max_before", F.greatest("_max_before", "_hi_carried"))
        body = body.withColumn("_next", F.coalesce("_next", "_lo_after"))
    return body.where("_max_before > _lo OR _next < _hi").select(*df.columns)


def closed_period_rows(
    df: DataFrame, lower: str, upper: str, other: tuple[str, str] | None = None, lower_too: bool = False
) -> DataFrame:
    """Rows with a finite upper bound (and lower one, when asked).

    With a second period, the rows of which both periods, or their lower bounds, differ are flagged.
    """
    closed = F.col(upper).isNotNull()
    if lower_too:
        closed = closed & F.col(lower).isNotNull()
    out = df.where(closed)
    if other is None:
        return out
    lower_differs = ~F.col(lower).eqNullSafe(F.col(other[0]))
    differs = lower_differs | ~F.col(upper).eqNullSafe(F.col(other[1]))
    return out.withColumn("period_differs", differs).withColumn("lower_differs", lower_differs)
