"""Pages far from the beginning of an order, without sorting what lies before them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.ordered import SLICE, slice_bounds, sliced_by
from tablewright.session import written

SAME_IN_DRIVER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.DecimalType)


def between(column: str, low: object, high: object) -> Column:
    """What a scan can check of a slice: values of the leading order column, NULL before all others."""
    at_least = F.lit(True) if low is None else F.col(column) >= F.lit(low)
    at_most = F.lit(True) if high is None else F.col(column) <= F.lit(high)
    return (at_least & at_most) if low is not None else (at_most | F.col(column).isNull())


def deep_page(
    df: DataFrame,
    order: Sequence[str],
    limit: int,
    offset: int | Callable[[int], int],
    slices: int | None = None,
    descending: bool = False,
    joined: bool = False,
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the order, with their ``position`` from 0.

    One pass counts the rows of each range of the order; only the ranges that hold the page are read and
    ranked, by row numbers that Spark limits before the shuffle. Ranges are cut from a sample, so their
    sizes vary, the page does not. The ranges hold about ``limit`` or a 200th of the rows, whichever is
    more, unless ``slices`` says how many there are. ``order`` must be a total order for repeatable pages;
    NULL comes first, or last if ``descending``. A page beyond the end is short or empty. The input is read
    three times, with few columns but for the last: hand over a table. Of ``joined`` tables the order columns
    are worked out once and written, so that the joins are done once for them and once for the page's ranges.
    An ``offset`` that depends on the number of rows is a function of it.
    """
    keys = df.select(*order)
    if joined:
        keys = written(keys, "page-keys")
    total = keys.count()
    offset = offset(total) if callable(offset) else offset
    first = max(0, total - offset - limit) if descending else min(offset, total)
    stop = max(0, total - offset) if descending else min(total, offset + limit)
    if slices is None:
        slices = max(1, min(200, total // max(1, limit)))
    bounds = slice_bounds(keys, order, slices, total)
    counts = {r[SLICE]: r["count"] for r in sliced_by(keys, order, bounds).groupBy(SLICE).count().collect()}
    bases, seen = {}, 0
    for i in range(len(bounds) + 1):
        if seen < stop and seen + counts.get(i, 0) > first:
            bases[i] = seen
        seen += counts.get(i, 0)
    leading = df.schema[order[0]].dataType
    rows = df.where(F.lit(False)) if not bases else df
    if bases and isinstance(leading, SAME_IN_DRIVER):
        low = bounds[min(bases) - 1][0] if min(bases) else None
        high = bounds[max(bases)][0] if max(bases) < len(bounds) else None
        rows = df.where(between(order[0], low, high))
    held = sliced_by(rows, order, bounds).where(F.col(SLICE).isin(*bases))
    most = max((stop - base for base in bases.values()), default=0)
    numbered = held.withColumn("_rn", F.row_number().over(Window.partitionBy(SLICE).orderBy(*order))).where(F.col("_rn") <= most)
    base = reduce(lambda a, i: F.when(F.col(SLICE) == i, bases[i]).otherwise(a), bases, F.lit(0))
    placed = numbered.withColumn("position", (base + F.col("_rn") - 1).cast("bigint"))
    page = placed.where((F.col("position") >= first) & (F.col("position") < stop)).drop(SLICE, "_rn")
    if descending:
        page = page.withColumn("position", F.lit(total - 1).cast("bigint") - F.col("position"))
    return page.orderBy("position")
