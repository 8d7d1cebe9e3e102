"""Sliced windows against plain windows, with one key holding most rows."""

import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.operators import windows
from tablewright.operators.ordered import SLICE, numbered, with_slices


def events(spark):
    """2,000 rows: key 7 has two thirds, key NULL some, many equal times, a few NULL times."""
    i = F.col("id")
    return spark.range(2000).select(
        i.alias("event_id"),
        F.when(i % 3 > 0, 7).when(i % 9 == 0, F.lit(None)).otherwise(i % 5).cast("int").alias("user_id"),
        F.when(i % 97 > 0, F.timestamp_add("SECOND", (i * 7919) % 500, F.lit("2024-03-10 01:30:00").cast("timestamp_ntz"))).alias("ts"),
    ).repartition(5)


def collected(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("partition", ["user_id", None])
@pytest.mark.parametrize("slices", [1, 7, 200])
def test_log_gap(spark, partition, slices):
    df = events(spark)
    window = Window.partitionBy(*([partition] if partition else [])).orderBy("ts", "event_id")
    want = df.select("event_id", F.row_number().over(window).cast("bigint").alias("rn"), F.lag("ts").over(window).alias("p"))
    got = windows.log_gap(df, "ts", "event_id", partition, slices=slices)
    assert collected(got, "event_id", "rn", "prev_time") == collected(want, "event_id", "rn", "p")


def test_slices_are_even_although_one_time_is_hot(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id")).alias("t"))
    sizes = [r["count"] for r in with_slices(df, ["t", "id"], 10)[0].groupBy(SLICE).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 600 and sum(sizes) == 3000


@pytest.mark.parametrize("slices", [5, 150])
def test_numbers_by_text_date_and_null_order(spark, slices):
    df = spark.range(1000).select(
        F.when(F.col("id") % 11 > 0, F.sha2(F.col("id").cast("string"), 256).substr(1, 2)).alias("s"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("d"),
        "id",
    )
    order = ["s", "d", "id"]
    want = df.select("id", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rn"))
    assert collected(numbered(df, order, slices=slices), "id", "rn") == collected(want, "id", "rn")


@pytest.mark.parametrize("partition", ["user_id", None])
@pytest.mark.parametrize("n", [6, 1200])
def test_log_tail(spark, partition, n):
    df = events(spark).where("ts IS NOT NULL")
    whole = windows.log_gap(df, "ts", "event_id", partition, slices=3)
    last = F.max("rn").over(Window.partitionBy(*([partition] if partition else [])))
    want = whole.withColumn("m", last).where(f"rn > m - {n} AND rn >= 4")
    got = windows.log_tail(df, "ts", "event_id", n, partition, from_row=4)
    cols = ["event_id", "rn", "prev_time", "gap_ms", "gap"]
    assert collected(got, *cols) == collected(want, *cols)


def at(hours):
    return None if hours is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


@pytest.mark.parametrize("slices", [1, 4, 50])
def test_overlapping_periods(spark, slices):
    spans = [
        (1, 0, 2), (1, 2, 3), (1, 5, 9), (1, 6, 7), (1, 8, 8), (2, None, 1), (2, 0, 4), (2, 4, None), (2, 3, 4),
        (3, None, None), (3, 100, 101), (4, 5, 6), (4, 5, 6), (5, 1, None), (5, 0, 1), (6, 3, 2),
    ]
    spans += [(9, 3 * i, 3 * i + (4 if i % 10 == 0 else 1)) for i in range(300)]
    data = [(k, i, at(a), at(b)) for i, (k, a, b) in enumerate(spans)]
    df = spark.createDataFrame(data, "k int, id int, lo timestamp_ntz, hi timestamp_ntz").repartition(4)
    low, high = datetime.datetime.min, datetime.datetime.max
    periods = [(k, i, a or low, b or high) for k, i, a, b in data if (a or low) < (b or high)]
    want = {
        i for k, i, a, b in periods if any(k == k2 and i != i2 and a < b2 and a2 < b for k2, i2, a2, b2 in periods)
    }
    got = windows.overlapping_periods(df, "k", "id", "lo", "hi", slices=slices)
    assert {r["id"] for r in got.collect()} == want and got.columns == df.columns


def test_number_periods(spark):
    df = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 4, None), (1, 3, None, 0)], "k int, id int, lo int, hi int")
    assert {r["id"] for r in windows.overlapping_periods(df, "k", "id", "lo", "hi").collect()} == {1, 2}


def test_gap_of_instants_over_a_clock_change(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(1, 1710052200), (2, 1710055800)], "id int, s long").select(
            "id", F.timestamp_seconds("s").alias("at"), F.timestamp_seconds("s").cast("timestamp_ntz").alias("clock")
        )
        assert windows.log_gap(df, "at", "id").where("id = 2").first()["gap"] == "01:00:00.000"
        assert windows.log_gap(df, "clock", "id").where("id = 2").first()["gap"] == "02:00:00.000"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
