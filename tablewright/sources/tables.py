"""Files and tables as inputs, and verified copies."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.predicates import column_of
from tablewright.operators.filters import union_all_sources


def file_listing(
    path: str, filter: str | Column | None = None, sort: str | Column | None = "filename", spark: SparkSession | None = None
) -> DataFrame:
    """(filename, size) of the files directly under a folder. File contents are not read."""
    session = spark or SparkSession.active()
    files = session.read.format("binaryFile").load(path)
    out = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"))
    if filter is not None:
        out = out.where(filter)
    return out if sort is None else out.orderBy(F.expr(sort) if isinstance(sort, str) else sort)


def union_numbered_tables(tables: Mapping[str, DataFrame], prefix: str, save_to: str | None = None) -> DataFrame:
    """All tables named by the prefix and digits, one after the other, by column position.

    With ``save_to`` the union is written there as Parquet and read back.
    """
    name = re.compile(re.escape(prefix) + r"\d+")
    found = sorted((n for n in tables if name.fullmatch(n)), key=lambda n: int(n[len(prefix) :]))
    if not found:
        raise ValueError(f"no table is named {prefix} and a number")
    united = union_all_sources(*[tables[n] for n in found])
    if save_to is None:
        return united
    united.write.mode("errorifexists").parquet(save_to)
    return united.sparkSession.read.parquet(save_to)


def read_numbered_files(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """The same for Parquet files or folders ``<prefix><digits>``: one scan, however many there are."""
    scan = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    pattern = f"/{re.escape(prefix)}[0-9]+([.][^/]*)?(/[^/]*)?$"
    return scan.where(F.col("_metadata.file_path").rlike(pattern))


def fingerprint(df: DataFrame) -> tuple[Column, Column]:
    """Aggregates ``rows`` and ``hash``: count, and a sum of row hashes that does not depend on row order."""
    cols = [column_of(c) for c in df.columns]
    row = F.xxhash64(*cols, *[c.isNull() for c in cols])
    return F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(38,0)")).alias("hash")


def table_copy_verified(df: DataFrame, target_path: str, name: str = "table") -> tuple[DataFrame, DataFrame]:
    """Write a table as Parquet, read it back and compare count and hash.

    Gives the copy and one check row (table, size estimate before the copy, rows on both sides, same).
    """
    spark = df.sparkSession
    row_size = F.length(F.to_json(F.struct(*[column_of(c) for c in df.columns]), {"ignoreNullFields": "false"}))
    rows, total = fingerprint(df)
    source = df.agg(F.coalesce(F.sum(row_size.cast("bigint")), F.lit(0)).alias("estimated_bytes"), rows, total)
    df.write.mode("errorifexists").parquet(target_path)
    copy = spark.read.parquet(target_path)
    written = copy.agg(*fingerprint(copy)).select(F.col("rows").alias("copy_rows"), F.col("hash").alias("_t"))
    check = source.crossJoin(F.broadcast(written)).select(
        F.lit(name).alias("table_name"),
        "estimated_bytes",
        F.col("rows").alias("source_rows"),
        "copy_rows",
        ((F.col("rows") == F.col("copy_rows")) & F.col("hash").eqNullSafe(F.col("_t"))).alias("same"),
    )
    return copy, check


def inline_relation(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small literal table."""
    return spark.createDataFrame(list(rows), schema)
