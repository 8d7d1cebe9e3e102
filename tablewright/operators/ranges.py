"""Joins of points with the intervals that hold them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.ordered import SLICE, running_total, slice_bounds, sliced_by
from tablewright.session import cut_lineage

POINTS_PER_BIN = 200_000


def range_join(
    points: DataFrame,
    point: str,
    intervals: DataFrame,
    low: str,
    high: str,
    holds: Callable[[], Column] | Column | None = None,
    bins: int | None = None,
    folds: Mapping[str, Callable[[str], Column]] | None = None,
    ties: Sequence[str] | None = None,
) -> DataFrame:
    """Every pair of a point and an interval with ``low <= point < high``; a NULL bound is infinite.

    The order of the points is cut into bins of near-equal counts, found from a sample. An interval is
    handed to the bins that it meets, a point to its own; so they meet by an equi-join on the bin, which
    adaptive execution can split, and no pair is made twice. ``holds`` is an exact condition in place of
    the comparison, where the three columns are keys that keep the order but may tie. Columns keep their
    names, so both sides must not share any. A NULL point is in no interval.

    ``folds`` asks for no pairs but for every interval that holds a point, with columns of its points folded,
    as in ``{"n": F.sum, "top": F.max}``: see :func:`_folded`. ``ties`` then names what orders points, lows
    and highs further where the keys tie.
    """
    if folds:
        return _folded(points, point, intervals, low, high, folds, ties, bins)
    some = points.where(F.col(point).isNotNull())
    if bins is None:
        bins = 1 + some.count() // POINTS_PER_BIN
    bounds = slice_bounds(some, [point], bins, some.count())
    placed = sliced_by(some, [point], bounds)
    last = F.lit(len(bounds))

    def bin_of(column: str, name: str, otherwise: Column) -> Column:
        return F.when(F.col(column).isNull(), otherwise).otherwise(F.col(name))

    cut = sliced_by(intervals, [low], bounds).withColumnRenamed(SLICE, "_from")
    cut = sliced_by(cut, [high], bounds).withColumnRenamed(SLICE, "_to")
    first, stop = bin_of(low, "_from", F.lit(0)), bin_of(high, "_to", last)
    met = cut.where(first <= stop).withColumn("_bin", F.explode(F.sequence(first, stop))).drop("_from", "_to")
    if holds is None:
        above = F.col(low).isNull() | (F.col(low) <= F.col(point))
        holds = above & (F.col(high).isNull() | (F.col(point) < F.col(high)))
    return placed.join(met, (F.col(SLICE) == F.col("_bin")) & (holds if isinstance(holds, Column) else holds())).drop(SLICE, "_bin")


def _blocks(first: Column, stop: Column, levels: int) -> Column:
    """The fewest blocks of 2^level neighbouring ranks that make up the ranks from ``first`` to ``stop - 1``."""
    found = []
    for level in range(levels):
        left, right = F.shiftright(first + F.lit((1 << level) - 1), level), F.shiftright(stop, level)
        for odd, block in ((left, left), (right, right - 1)):
            of = F.struct(F.lit(level).alias("_level"), block.alias("_block"))
            found.append(F.when((left < right) & (odd % 2 == 1), of))
    return F.filter(F.array(*found), lambda b: b.isNotNull())


def _folded(
    points: DataFrame,
    point: str,
    intervals: DataFrame,
    low: str,
    high: str,
    folds: Mapping[str, Callable[[str], Column]],
    ties: Sequence[str] | None,
    slices: int | None,
) -> DataFrame:
    """Intervals with their points folded, without a pair of point and interval.

    Equal points are folded first. Points and bounds get their rank in one sorted pass, ranks are folded in
    blocks of 1, 2, 4 and so on, and an interval puts together at most two blocks of each size; so n points
    and m intervals cost (n + m) log n rows, whatever the intervals hold. A fold is applied to its own
    results and must ignore NULL, as sum, max and min do.
    """
    names = dict(zip((point, low, high), ties)) if ties else {}
    again = [fold(name).alias(name) for name, fold in folds.items()]

    def places(df: DataFrame, column: str, one: int, *more: str) -> DataFrame:
        tie = F.col(names[column]) if names else F.lit(0)
        some = df.where(F.col(column).isNotNull())
        return some.select(F.col(column).alias("_key"), tie.alias("_tie"), F.lit(one).cast("bigint").alias("_one"), *more)

    bounds = places(intervals, low, 0).union(places(intervals, high, 0))
    known = places(points, point, 1, *folds).unionByName(bounds, allowMissingColumns=True)
    known = cut_lineage(known.groupBy("_key", "_tie").agg(F.max("_one").alias("_one"), *again))
    ranked = cut_lineage(running_total(known, ["_key"], None, "_one", "_rank", slices, ["_tie"]))
    values = ranked.where("_one = 1")
    count = values.count()
    levels = max(1, count.bit_length())
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_level")
    leveled = values.select("_rank", level, *folds).withColumn("_block", F.expr("shiftright(_rank, _level)"))
    blocks = leveled.groupBy("_level", "_block").agg(*again)

    spans = intervals
    for column, rank, infinite in ((low, "_first", 0), (high, "_stop", count)):
        at = ranked.select(F.col("_key").alias("_at"), F.col("_tie").alias("_at_tie"), F.col("_rank").alias(rank))
        same = F.col(column) == F.col("_at")
        if names:
            same = same & (F.col(names[column]) == F.col("_at_tie"))
        spans = spans.join(at, same, "left").drop("_at", "_at_tie").withColumn(
            rank, F.when(F.col(column).isNull(), F.lit(infinite).cast("bigint")).otherwise(F.col(rank))
        )
    spans = spans.where("_first < _stop")
    wanted = spans.select("_first", "_stop").distinct()
    pieces = wanted.select("_first", "_stop", F.inline(_blocks(F.col("_first"), F.col("_stop"), levels)))
    folded = pieces.join(blocks, ["_level", "_block"]).groupBy("_first", "_stop").agg(*again)
    return spans.join(folded, ["_first", "_stop"]).drop("_first", "_stop")
