"""Checks over many tables at once: one plan, every table read in one pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.filters import union_all_sources


def row_counts_all_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_all_sources(
        *[df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    )


def footer_row_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(table_name, row_count) of Parquet tables from the row counts in their file footers.

    The count is pushed into the source, in a session of its own whose settings allow it; where Spark
    cannot push it, the table is scanned and the count is the same.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    counts = row_counts_all_tables({n: session.read.parquet(p) for n, p in paths.items()})
    # The sum of pushed counts is NULL for a table without row groups, though the plan takes it for a number.
    zeros = session.createDataFrame([(n, 0) for n in paths], counts.schema)
    return counts.union(zeros).groupBy("table_name").agg(F.sum("row_count").alias("row_count"))


def predicate_counts_all_tables(
    tables: Mapping[str, DataFrame], required_cols: Sequence[str], predicate: Callable[[], Column]
) -> DataFrame:
    """Rows meeting a predicate in every table that has all the named columns; tables with none left out."""
    counts = [
        df.agg(F.count_if(predicate()).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        for n, df in tables.items()
        if set(required_cols) <= set(df.columns)
    ]
    if not counts:
        raise ValueError(f"no table has the columns {list(required_cols)}")
    return union_all_sources(*counts).where("row_count > 0")


def _sentinel_counts(table: str, df: DataFrame, columns: Sequence[str], sentinel: str) -> DataFrame:
    """(table, column, hits, correct) for several columns from one aggregate. NULL is in neither count."""
    aggs = []
    for i, c in enumerate(columns):
        text = F.col(c).cast("string")
        aggs += [F.count_if(text == sentinel).alias(f"h{i}"), F.count_if(text != sentinel).alias(f"c{i}")]
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"h{i}").alias("hits"), F.col(f"c{i}").alias("correct"))
            for i, c in enumerate(columns)
        ]
    )
    return df.agg(*aggs).select(F.lit(table).alias("table_name"), F.inline(rows))


def _with_ratio(counts: DataFrame) -> DataFrame:
    total = F.col("hits") + F.col("correct")
    return counts.withColumn("total", total).withColumn(
        "error_ratio", F.round(F.try_divide(F.col("hits").cast("double"), total.cast("double")), 4)
    )


def sentinel_ratio(tables: Mapping[str, DataFrame], column: str, sentinel: str) -> DataFrame:
    """Share of a sentinel value in one named column, in every table that has it."""
    counts = [_sentinel_counts(n, df, [column], sentinel) for n, df in tables.items() if column in df.columns]
    if not counts:
        raise ValueError(f"no table has the column {column}")
    return _with_ratio(union_all_sources(*counts))


def sentinel_scan_all_columns(
    tables: Mapping[str, DataFrame],
    sentinel: str,
    skip: Sequence[str] = (),
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Share of a sentinel value in every text column of every table, where it occurs at all.

    ``limit`` and ``offset`` page over the list of (table, column) names, not over rows.
    """
    names = [
        (table, f.name)
        for table, df in sorted(tables.items())
        for f in df.schema.fields
        if isinstance(f.dataType, (T.StringType, T.VariantType)) and f.name not in skip
    ]
    page = names[offset:] if limit is None else names[offset : offset + limit]
    by_table: dict[str, list[str]] = {}
    for table, column in page:
        by_table.setdefault(table, []).append(column)
    counts = [_sentinel_counts(t, tables[t], cols, sentinel) for t, cols in by_table.items()]
    if not counts:
        raise ValueError("no text column on this page")
    return _with_ratio(union_all_sources(*counts)).where("hits > 0")
