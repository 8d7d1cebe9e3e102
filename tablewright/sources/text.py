"""Text lines as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.sources.tables import file_listing


def text_lines_numbered(
    source: DataFrame | str, text_col: str | None = None, spark: SparkSession | None = None
) -> DataFrame:
    """(line_no, line) numbered from 0: of text files, or of every text in a column."""
    if isinstance(source, str):
        return _file_lines(spark or SparkSession.active(), source)
    others = [c for c in source.columns if c != text_col]
    lines = source.select(*others, F.posexplode(F.split(F.col(text_col), "\n")).alias("_pos", "line"))
    return lines.select(*others, F.col("_pos").cast("bigint").alias("line_no"), "line")


def _file_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of each file, numbered without bringing a file into one task.

    Spark reads a file in blocks. Inside a block the row ids rise in line order; the line counts of
    the blocks before it give the first number. Only the block counts are ordered together.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        F.col("value").alias("line"),
    )
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        lines.groupBy(F.col("file").alias("_file"), F.col("_block").alias("_start"))
        .agg(F.count(F.lit(1)).alias("_lines"), F.min("_row").alias("_first"))
        .select("_file", "_start", "_first", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_skipped"))
    )
    joined = lines.join(blocks, (F.col("file") == F.col("_file")) & (F.col("_block") == F.col("_start")), "inner")
    return joined.select("file", (F.col("_row") - F.col("_first") + F.col("_skipped")).alias("line_no"), "line")


def dump_line_filter(lines: DataFrame, drop_regex: str, col: str = "line") -> DataFrame:
    """Lines in which the pattern is not found."""
    return lines.where(~F.col(col).rlike(drop_regex))


def copy_dump(spark: SparkSession, source: str, target: str, drop_regex: str, lines_per_part: int = 0) -> None:
    """Copy a text dump, packed or not, without the matching lines; written as gzip parts.

    A packed file can be unpacked by one task only. With ``lines_per_part`` no part of the copy holds more
    lines than that, so whatever reads the copy does so with a task per part. Parts follow one another in
    the order of their names: put one behind the other they are one gzip file of as many members.
    """
    kept = dump_line_filter(spark.read.text(source), drop_regex, "value")
    writer = kept.write.mode("errorifexists").option("compression", "gzip").option("maxRecordsPerFile", lines_per_part)
    writer.text(target)


def dump_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The index of a packed copy: (part, filename, size, first_byte), a row per part, sizes in packed bytes.

    ``first_byte`` is where the part begins when all are put into one file. One row per part is ordered
    together; the lines are not read.
    """
    parts = file_listing(folder, F.col("filename").startswith("part-"), None, spark)
    order = Window.partitionBy(F.lit(0)).orderBy("filename")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    number = (F.row_number().over(order) - 1).cast("bigint")
    return parts.select(number.alias("part"), "filename", "size", before.alias("first_byte"))
