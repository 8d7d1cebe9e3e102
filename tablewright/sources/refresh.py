"""Copies of tables that are brought up to date range by range."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.predicates import column_of
from tablewright.operators.ordered import SLICE, order_point, slice_bounds, sliced_by
from tablewright.operators.paging import SAME_IN_DRIVER, between
from tablewright.sources.tables import fingerprint

RANGE = "copy_range"
_CHECK = "table_name string, range_no int, source_rows bigint, copy_rows bigint, moved boolean, same boolean"


def start_copy(df: DataFrame, target: str, key: str | Sequence[str], ranges: int = 1000, name: str = "table") -> tuple[DataFrame, DataFrame]:
    """First copy of a table, cut in ``ranges`` by near-equal row counts of the key; see :func:`refresh_copy`.

    The borders are placed by a sample and kept with the copy; every row belongs to exactly one range,
    NULL keys to the first. ``key`` should be close to unique: rows of one key share a range.
    """
    key = [key] if isinstance(key, str) else list(key)
    if RANGE in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {RANGE}")
    keys = df.select(*key)
    bounds = slice_bounds(keys, key, ranges, keys.count())
    points = keys.select(order_point(keys, key).alias("point")).schema
    numbered = T.StructType([T.StructField("position", T.IntegerType()), *points.fields])
    df.limit(0).write.mode("errorifexists").parquet(f"{target}/empty")
    _put(df.sparkSession.createDataFrame(list(enumerate(bounds)), numbered), f"{target}/borders")
    return refresh_copy(df, target, key, name)


def refresh_copy(df: DataFrame, target: str, key: str | Sequence[str], name: str = "table") -> tuple[DataFrame, DataFrame]:
    """Bring a copy up to date: only ranges whose fingerprint differs are written again.

    One pass over the source gives a fingerprint (count and hash sum) per range; the copy is not read, its
    fingerprints lie beside it. Ranges that differ are read once more and written to a folder of the new
    version, checked as they lie there, and then named in that version's list of ranges. The list is one
    file and comes last, so a refresh that stops leaves the copy as it was, and is simply run again. Folders
    of earlier versions stay. Gives the copy, and a check row per range: (table_name, range_no,
    source_rows, copy_rows, moved, same). A range of no rows on either side has none.
    """
    spark = df.sparkSession
    key = [key] if isinstance(key, str) else list(key)
    if df.schema.simpleString() != spark.read.parquet(f"{target}/empty").schema.simpleString():
        raise ValueError("the columns of the copy are not those of the table")
    bounds = [tuple(r["point"]) for r in spark.read.parquet(f"{target}/borders").orderBy("position").collect()]
    held, version = _ranges(spark, target)
    now = _by_range(sliced_by(df, key, bounds).withColumnRenamed(SLICE, RANGE))
    differ = [r for r in now if r not in held or now[r] != held[r][1:]]
    kept = {r: held[r] for r in held if r in now and r not in differ}
    if differ:
        folder = f"{target}/rows/version={version + 1}"
        part = df
        if isinstance(df.schema[key[0]].dataType, SAME_IN_DRIVER):
            part = df.where(_stretches(key[0], sorted(differ), bounds))
        moved = sliced_by(part, key, bounds).withColumnRenamed(SLICE, RANGE).where(F.col(RANGE).isin(differ))
        moved.hint("rebalance", RANGE).write.mode("overwrite").partitionBy(RANGE).parquet(folder)
        fields = [*df.schema.fields, T.StructField(RANGE, T.IntegerType())]
        written = _by_range(spark.read.schema(T.StructType(fields)).parquet(folder))
        kept |= {r: (version + 1, *written[r]) for r in written}
    if differ or len(kept) < len(held) or version < 0:
        listed = [(r, v, rows, total) for r, (v, rows, total) in sorted(kept.items())]
        schema = "range_no int, held_in int, rows bigint, hash decimal(38,0)"
        _put(spark.createDataFrame(listed, schema), f"{target}/ranges/version={version + 1}")
    checks = []
    for r in sorted(now.keys() | held.keys()):
        there, copied = now.get(r, (0, None)), kept.get(r, (None, 0, None))[1:]
        checks.append((name, r, there[0], copied[0], r in differ or r not in now, there == copied))
    return read_copy(spark, target), spark.createDataFrame(checks, _CHECK)


def read_copy(spark: SparkSession, target: str) -> DataFrame:
    """The copy as its last finished refresh left it."""
    empty = spark.read.parquet(f"{target}/empty")
    held, _ = _ranges(spark, target)
    folders = [f"{target}/rows/version={v}/{RANGE}={r}" for r, (v, _, _) in sorted(held.items())]
    return spark.read.schema(empty.schema).parquet(*folders) if folders else empty


def _put(rows: DataFrame, path: str) -> None:
    """A list of at most one row per range, as one file."""
    rows.coalesce(1).write.mode("overwrite").parquet(path)


def _ranges(spark: SparkSession, target: str) -> tuple[dict[int, tuple], int]:
    """The last list of ranges, at most ``ranges`` entries, and its version; -1 before the first."""
    try:
        lists = spark.read.parquet(f"{target}/ranges")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}, -1
    names = [f.rsplit("/version=", 1)[1].split("/")[0] for f in lists.inputFiles()]
    version = max(int(n) for n in names)
    rows = lists.where(F.col("version") == version).collect()
    return {r["range_no"]: (r["held_in"], r["rows"], r["hash"]) for r in rows}, version


def _by_range(placed: DataFrame) -> dict[int, tuple]:
    """Count and hash sum per range; the sums are combined before the shuffle, one row per range comes back."""
    plain = placed.select(*[column_of(c) for c in placed.columns if c != RANGE])
    return {r[RANGE]: (r["rows"], r["hash"]) for r in placed.groupBy(RANGE).agg(*fingerprint(plain)).collect()}


def _stretches(column: str, ranges: Sequence[int], bounds: list[tuple]) -> Column:
    """What a scan can check of these ranges: the leading key column within one of their stretches."""
    found: list[list[int]] = []
    for r in ranges:
        if found and found[-1][1] == r - 1:
            found[-1][1] = r
        else:
            found.append([r, r])
    ends = [(bounds[a - 1][0] if a else None, bounds[b][0] if b < len(bounds) else None) for a, b in found]
    return reduce(lambda one, two: one | two, [between(column, low, high) for low, high in ends])
