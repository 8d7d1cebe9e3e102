"""The log gap stream over several arrivals."""

import datetime

from pyspark.sql import functions as F

from tablewright.operators.windows import log_gap
from tablewright.streaming.log_gap import write_log_gap

SCHEMA = "event_id long, user_id long, ts timestamp"


def arrive(spark, folder, data):
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(i, u, start + datetime.timedelta(seconds=s)) for i, u, s in data]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run_ordered(spark, folder, tmp_path, delay):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    query = write_log_gap(stream, "user_id", "ts", "event_id", str(tmp_path / "out"), str(tmp_path / "state"), delay)
    dropped = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    out = spark.read.parquet(str(tmp_path / "out"))
    return {r["event_id"]: r["gap_us"] for r in out.collect()}, dropped


def test_late_rows_are_put_in_order(spark, tmp_path):
    """Rows up to 20 seconds late, over two runs of the job, have the gaps of the batch job."""
    folder, data = str(tmp_path / "in"), {}
    for part in range(4):
        rows = [(100 * part + i, i % 3, 30 * part + (i * 7919) % 50) for i in range(40)]
        data |= {i: (u, s) for i, u, s in rows}
        arrive(spark, folder, rows)
        if part == 1:
            some, dropped = run_ordered(spark, folder, tmp_path, "20 seconds")
            assert dropped == 0 and 0 < len(some) < 80
    arrive(spark, folder, [(999, 9, 10_000)])
    got, dropped = run_ordered(spark, folder, tmp_path, "20 seconds")
    arrived = spark.read.parquet(folder).where("event_id <> 999")
    micros = F.unix_micros("ts") - F.unix_micros("prev_time")
    batch = log_gap(arrived, "ts", "event_id", "user_id").select("event_id", micros.alias("g")).collect()
    assert dropped == 0 and got == {r["event_id"]: r["g"] for r in batch}
    # Later than the delay: dropped and counted, never given a wrong gap.
    arrive(spark, folder, [(1000, 1, 5), (1001, 1, 20_000)])
    again, dropped = run_ordered(spark, folder, tmp_path, "20 seconds")
    assert dropped == 1 and 1000 not in again and set(got) <= set(again)


def run(spark, folder, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    write_log_gap(stream, "user_id", "ts", "event_id", str(tmp_path / "out"), str(tmp_path / "state"))
    out = spark.read.parquet(str(tmp_path / "out"))
    return {r["event_id"]: (r["gap_us"], r["late"]) for r in out.collect()}


def test_gaps_cross_batches_and_late_rows_are_told(spark, tmp_path):
    folder = str(tmp_path / "in")
    arrive(spark, folder, [(1, 1, 10), (2, 1, 5), (3, 2, 7)])
    assert run(spark, folder, tmp_path) == {2: (None, False), 1: (5_000_000, False), 3: (None, False)}
    arrive(spark, folder, [(4, 1, 12), (5, 1, 8), (6, 2, 7), (7, 3, 1)])
    arrive(spark, folder, [(8, 3, 4), (9, 1, 13)])
    got = run(spark, folder, tmp_path)
    assert got[4] == (2_000_000, False) and got[5] == (None, True) and got[6] == (0, False)
    assert got[8] == (3_000_000, False) and got[9] == (1_000_000, False) and len(got) == 9


def test_stream_equals_batch_when_nothing_is_late(spark, tmp_path):
    folder = str(tmp_path / "in")
    for part in range(4):
        arrive(spark, folder, [(100 * part + i, i % 3, 1000 * part + (i * 37) % 50) for i in range(40)])
    got = run(spark, folder, tmp_path)
    batch = log_gap(spark.read.parquet(folder), "ts", "event_id", "user_id", slices=4)
    micros = F.unix_micros("ts") - F.unix_micros("prev_time")
    assert got == {r["event_id"]: (r["g"], False) for r in batch.select("event_id", micros.alias("g")).collect()}
