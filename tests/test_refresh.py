"""Copies brought up to date by ranges, against the table itself."""

import datetime

import pytest
from pyspark.sql import functions as F

from tablewright.session import scratch_path
from tablewright.sources.refresh import read_copy, refresh_copy, start_copy


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def moved(checks):
    return {r["range_no"] for r in checks.where("moved").collect()}


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(4000).select("id", (F.col("id") % 7).alias("a.b"), F.when(F.col("id") % 5 > 0, F.lit("x")).alias("s"))


def test_only_ranges_that_differ_move(spark, table):
    path = scratch_path(spark, "refresh")
    copy, checks = start_copy(table, path, "id", ranges=40)
    assert rows(copy) == rows(table) and checks.where("same AND moved").count() == checks.count() > 20
    _, again = refresh_copy(table, path, "id")
    assert moved(again) == set() and again.where("NOT same").isEmpty()
    sizes = {r["range_no"]: r["copy_rows"] for r in checks.collect()}
    place, seen = {}, 0
    for r in sorted(sizes):
        place |= {i: r for i in range(seen, seen + sizes[r])}
        seen += sizes[r]
    edited = table.withColumn("s", F.when(F.col("id").between(1000, 1039), "new").otherwise(F.col("s"))).where("id <> 3000")
    copy, checks = refresh_copy(edited.union(spark.sql("SELECT 9000L, 1L, 'end'")), path, "id")
    assert moved(checks) == {place[i] for i in range(1000, 1040)} | {place[3000], max(sizes)}
    assert checks.where("NOT same").isEmpty()
    assert rows(copy) == rows(edited.union(spark.sql("SELECT 9000L, 1L, 'end'")))


def test_emptied_ranges_and_nulls(spark, table):
    path = scratch_path(spark, "refresh")
    keyed = table.select(F.when(F.col("id") >= 30, F.col("id")).alias("id"), "s")
    start_copy(keyed, path, ["id", "s"], ranges=10)
    less = keyed.where("id IS NULL OR id > 2000")
    copy, checks = refresh_copy(less, path, ["id", "s"])
    assert rows(copy) == rows(less) == rows(read_copy(spark, path))
    assert checks.where("source_rows = 0").count() >= 3 and checks.where("NOT same").isEmpty()
    copy, checks = refresh_copy(keyed.limit(0), path, ["id", "s"])
    assert rows(copy) == [] and checks.where("NOT same OR copy_rows > 0").isEmpty()
    copy, checks = refresh_copy(keyed, path, ["id", "s"])
    assert rows(copy) == rows(keyed)


def test_an_empty_table_and_other_columns(spark, table):
    path = scratch_path(spark, "refresh")
    copy, checks = start_copy(table.limit(0), path, "id")
    assert rows(copy) == [] and checks.isEmpty()
    copy, _ = refresh_copy(table, path, "id")
    assert rows(copy) == rows(table)
    with pytest.raises(ValueError):
        refresh_copy(table.drop("s"), path, "id")


def test_keys_of_dates_and_text(spark):
    day = datetime.date(2020, 1, 1)
    data = [(day + datetime.timedelta(i % 50) if i % 9 else None, f"k{i % 13}", i) for i in range(500)]
    df = spark.createDataFrame(data, "d date, k string, n int")
    path = scratch_path(spark, "refresh")
    start_copy(df, path, ["d", "k"], ranges=12)
    later = df.withColumn("n", F.when((F.col("d") == day) & (F.col("k") == "k1"), -1).otherwise(F.col("n")))
    copy, checks = refresh_copy(later, path, ["d", "k"])
    assert rows(copy) == rows(later) and len(moved(checks)) <= 1


def test_a_refresh_that_stopped_changes_nothing(spark, table):
    path = scratch_path(spark, "refresh")
    start_copy(table, path, "id", ranges=8)
    edited = table.withColumn("s", F.lit("z"))
    edited.limit(3).withColumn("copy_range", F.lit(2)).write.partitionBy("copy_range").parquet(f"{path}/rows/version=1")
    assert rows(read_copy(spark, path)) == rows(table)
    copy, checks = refresh_copy(edited, path, "id")
    assert rows(copy) == rows(edited) and checks.where("NOT same").isEmpty()
