"""Reports over query logs, activity and usage counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.predicates import as_col, micros_between
from tablewright.functions.text import format_interval, readable_size
from tablewright.operators.aggregates import share_of_total
from tablewright.operators.filters import ilike_filter
from tablewright.session import cut_lineage


def _elapsed_ms(df: DataFrame, start: str, as_of: Column) -> Column:
    zoned = isinstance(df.schema[start].dataType, T.TimestampType)
    return F.floor(micros_between(F.col(start), as_of, zoned) / F.lit(1000)).cast("bigint")


def running_queries(
    df: DataFrame,
    exclude_id,
    as_of: Column,
    *,
    id_col: str = "query_id",
    start: str = "start_time",
    done: str = "read_rows",
    expected: str = "total_rows",
    memory: str = "memory_usage",
) -> DataFrame:
    """Running items but one's own, longest first: time so far, percent done and memory as text."""
    return (
        df.where(F.col(id_col) != F.lit(exclude_id))
        .withColumn("elapsed_ms", _elapsed_ms(df, start, as_of))
        .withColumn("elapsed", format_interval("elapsed_ms"))
        .withColumn("percent", F.round(F.try_divide(F.col(done).cast("double"), F.col(expected).cast("double")) * 100, 2))
        .withColumn("mem_usage", readable_size(memory))
        .orderBy(F.col("elapsed_ms").desc(), id_col)
    )


def query_log_search(
    df: DataFrame,
    like: Sequence[str] = (),
    not_like: Sequence[str] = (),
    *,
    text: str = "query",
    duration_ms: str = "duration_ms",
    memory: str = "memory_usage",
    time: str = "event_time",
    tie: str = "query_id",
) -> DataFrame:
    """Finished items by text, newest first, with time and memory as text."""
    return (
        ilike_filter(df, text, like, not_like)
        .withColumn("elapsed", format_interval(F.col(duration_ms).cast("bigint")))
        .withColumn("mem_usage", readable_size(memory))
        .orderBy(F.col(time).desc(), F.col(tie).desc())
    )


def workload_top(df: DataFrame, statement: str, time: str, rows: str, min_total=1) -> DataFrame:
    """Per statement: calls, total time and its share, mean time and rows per call; small totals left out.

    Shares are of the statements shown. The log is read once, into one row per statement.
    """
    grouped = cut_lineage(
        df.groupBy(statement)
        .agg(F.count(F.lit(1)).alias("calls"), F.sum(time).alias("_time"), F.sum(rows).alias("rows"))
        .where(F.col("_time") >= min_total)
    )
    return (
        share_of_total(grouped, "_time", 2, "total_time_share")
        .withColumn("total_time_ms", F.round(F.col("_time").cast("double"), 3))
        .withColumn("total_time_hr", format_interval(F.bround(F.col("_time").cast("double"), 0).cast("bigint")))
        .withColumn("avg_time_ms", F.round(F.col("_time").cast("double") / F.col("calls"), 3))
        .withColumn("avg_rows", F.floor(F.col("rows") / F.col("calls")).cast("bigint"))
        .drop("_time")
        .orderBy(F.col("total_time_ms").desc(), statement)
    )


def activity_ages(
    df: DataFrame,
    ts_cols: Mapping[str, str],
    as_of: Column,
    skip_states: Sequence[str] = ("idle",),
    *,
    state: str = "state",
    sort: Sequence[str] | None = None,
    then: Sequence[Column | str] = (),
) -> DataFrame:
    """Ages of several timestamps at a moment, as text, for sessions that are not idle.

    ``ts_cols`` maps an age name to a timestamp column; rows sort by the ages named in ``sort``
    (the first two), oldest first.
    """
    out = df.where(~F.col(state).isin(*skip_states)) if skip_states else df
    for name, ts in ts_cols.items():
        out = out.withColumn(name, format_interval(_elapsed_ms(df, ts, as_of)))
    by = list(sort or list(ts_cols)[:2])
    return out.orderBy(*[F.col(ts_cols[n]).asc_nulls_first() for n in by], *then)


def rarely_used(
    df: DataFrame,
    use: Column | str,
    definition: str,
    counters: Sequence[str],
    max_use: int = 200,
    not_regex: str | None = None,
    order: Sequence[Column | str] = (),
) -> DataFrame:
    """Items used less than a threshold whose definition does not match; writes are the sum of counters."""
    out = df.where(as_col(use) < max_use)
    if not_regex:
        out = out.where(~F.col(definition).rlike("(?iu)" + not_regex))
    writes = F.lit(0)
    for c in counters:
        writes = writes + F.col(c)
    return out.withColumn("num_writes", writes).orderBy(as_col(use), *order)


def usage_with_sizes(
    entities: DataFrame, usage: DataFrame, key: tuple[str, str], sizes: Sequence[str], order: Sequence[Column | str] = ()
) -> DataFrame:
    """Entities with their usage counters, if any, largest first by two sizes."""
    entity_key, usage_key = key
    counters = usage.withColumnRenamed(usage_key, "_key")
    out = entities.join(counters, entities[entity_key] == counters["_key"], "left").drop("_key")
    return out.orderBy(*[F.col(s).desc_nulls_first() for s in sizes], *order)
