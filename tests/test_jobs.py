"""Joins, groups, change jobs and sources on small inputs with awkward values."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from tablewright.operators import aggregates, changes, filters, joins, quality
from tablewright.session import scratch_path
from tablewright.sources import tables
from tablewright.sources.text import copy_dump, dump_parts, text_lines_numbered


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_not_in_follows_sql_on_null(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    other = spark.createDataFrame([(2,), (2,)], "y int")
    assert rows(joins.not_in_subquery(df, "x", other, "y")) == [(1,)]
    assert rows(joins.not_in_subquery(df, "x", other.where("y > 5"), "y")) == [(1,), (2,), (None,)]
    assert rows(joins.not_in_subquery(df, "x", other.union(spark.sql("SELECT CAST(NULL AS INT)")), "y")) == []


def test_full_outer_and_one_sided(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, x string")
    b = spark.createDataFrame([(1, "p"), (3, "q"), (3, "r"), (None, "s")], "j int, y string")
    want = a.join(b, a["k"] == b["j"], "full")
    assert rows(joins.full_outer_by_key(a, b, ("k", "j"))) == rows(want)
    lone = joins.one_sided_keys(a, b, ("k", "j"))
    assert rows(lone) == sorted([(2, "left"), (None, "left"), (3, "right"), (3, "right"), (None, "right")], key=repr)


def test_or_join_keeps_a_pair_once(spark):
    a = spark.createDataFrame([(1,), (2,)], "x int")
    b = spark.createDataFrame([(1, 1), (1, 2), (None, 2), (2, None), (3, 3)], "p int, q int")
    want = a.join(b, (a["x"] == b["p"]) | (a["x"] == b["q"]), "inner")
    assert rows(joins.or_condition_join(a, "x", b, ("p", "q"))) == rows(want)


def test_lookup_by_name_or_first_token(spark):
    df = spark.createDataFrame([(1, 7, "st"), (2, 7, "st.x"), (3, 7, "zz"), (4, 8, "st"), (5, 7, None)], "id int, lvl int, s string")
    look = spark.createDataFrame([(7, "st", "street"), (7, "st.x", "exact"), (7, "st", "second")], "level int, key string, v string")
    got = joins.lookup_exact_or_prefix_join(df, look, ("lvl", "level"), "s", "key", ["v"])
    assert rows(got.select("id", "v")) == sorted(
        [(1, "street"), (1, "second"), (2, "exact"), (2, "street"), (2, "second"), (3, None), (4, None), (5, None)], key=repr
    )


def test_pair_count(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "id int")
    want = df.alias("a").join(df.alias("b"), F.col("a.id") != F.col("b.id")).count()
    assert joins.nonequi_self_join_count(df, "id").first()["pairs"] == want
    assert joins.nonequi_self_join_count(df, "id", F.col("id") > 5).first()["pairs"] == 0


def test_groups_with_one_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id", F.lit(2).alias("s"))
    got = aggregates.duplicate_groups(df, "k", "id", "s").collect()
    assert [tuple(r) for r in got] == [(3333, 6666, 1, 2, 4, 5)]
    small = aggregates.group_having_collect(df, "k", "id", 2)
    assert small.count() == 1667 and small.where("k = 'hot'").isEmpty()
    assert rows(aggregates.group_having_collect(df, "k", "id", 3000)) == rows(small)
    pairs = spark.createDataFrame([("a", "bc", 1), ("ab", "c", 2), (None, "", 3), ("", None, 4)], "x string, y string, id int")
    assert aggregates.duplicate_groups(pairs, ["x", "y"], "id").isEmpty()


def test_versions_below_the_latest(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (None, 5), (None, 6), (2, None)], "k int, v int")
    assert rows(filters.not_latest_version(df, "v", "k")) == sorted([(1, 1), (None, 5)], key=repr)
    assert rows(filters.not_latest_version(df, "v")) == sorted([(1, 1), (1, 2), (1, 2), (None, 5)], key=repr)


def test_sentinels(spark):
    a = spark.createDataFrame([("bad", 1), ("ok", 2), (None, 3)], "t string, n int")
    b = spark.createDataFrame([("ok",)], "t string")
    assert rows(quality.sentinel_ratio({"a": a, "b": b}, "t", "bad")) == [("a", "t", 1, 1, 2, 0.5), ("b", "t", 0, 1, 1, 0.0)]
    assert rows(quality.sentinel_scan_all_columns({"a": a, "b": b}, "bad")) == [("a", "t", 1, 1, 2, 0.5)]
    assert quality.sentinel_scan_all_columns({"a": a, "b": b}, "bad", offset=1).isEmpty()


def test_status_order(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "id int, golden int")
    assert rows(changes.duplicate_status(df, "id", "golden").select("id", "duplicate_status")) == [(1, 2), (2, 2), (3, 3), (4, 1)]


def test_remap_follows_chains(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (49, 51), (60, 60)], "old_key int, new_key int")
    parent = spark.createDataFrame([(i, "own", f"sub{i}") for i in [*range(1, 45), 49, 50, 51]], "id int, orig string, sub string")
    child = spark.createDataFrame([(1, 40), (2, 1), (3, 44), (4, 51), (5, None)], "c int, ref int")
    out = changes.key_remap_cascade(pairs, {"child": (child, "ref")}, parent, "id", origin=("orig", "sub"))
    assert rows(out["child"].select("c", "ref")) == [(1, 1), (2, 1), (3, 44), (4, 49), (5, None)]
    left = {r["id"]: r["orig"] for r in out["parent"].collect()}
    assert set(left) == {1, 41, 42, 43, 44, 49, 50} and left[1] == "sub1" and left[49] == "sub49" and left[50] == "own"
    for cycle in ([(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1)]):
        with pytest.raises(ValueError, match="cycle"):
            changes.resolve_chains(spark.createDataFrame(cycle, "old_key int, new_key int"))


def test_delete_in_batches(spark, tmp_path):
    df = spark.range(25_000).withColumn("k", F.col("id") % 500)
    targets = spark.createDataFrame([(k,) for k in [*range(100), 7, None, 9999]], "k long")
    left, progress = changes.batched_delete(df, targets, "k", str(tmp_path / "a"), 1000)
    assert rows(left) == rows(df.where("k >= 100"))
    log = progress.orderBy("step").collect()
    assert [r.step for r in log] == [1, 2, 3, 4, 5] and log[-1].done_percent == 100.0
    assert [r.deleted for r in log] == sorted(r.deleted for r in log) and log[-1].deleted == log[-1].total == 5000
    times = spark.createDataFrame([(1, 100), (2, 300)], "step long, ms long")
    timed = {r["step"]: r for r in changes.batch_progress_log(progress.drop("ms"), times).collect()}
    assert [timed[i]["eta_ms"] for i in (1, 2, 3)] == [400, 600, None]
    own = changes.batch_progress_log(progress).orderBy("step").collect()
    assert own[-1].eta_ms == 0 and all(r.eta_ms is not None and "of 5" in r.message for r in own)
    none, no_progress = changes.batched_delete(df, df.where("id < 0").select("k"), "k", str(tmp_path / "b"))
    assert rows(none) == rows(df) and no_progress.isEmpty()
    empty, _ = changes.batched_delete(df.where("id < 0"), targets, "k", str(tmp_path / "c"))
    assert empty.isEmpty()


def test_delete_goes_on_after_it_stopped(spark, tmp_path):
    """Three batches, then a batch that dies after it wrote its rows, then the rest by another object."""
    path = str(tmp_path / "job")
    df = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 9 > 0, F.col("id") % 50).alias("k"), F.lit("x").alias("step"))
    changes.BatchedDelete.plan(df, spark.range(25).toDF("k"), "k", path, 300).run(most=3)
    job = changes.BatchedDelete(spark, path)
    assert sorted(r.step for r in job.journal().collect()) == [1, 2, 3]
    half = rows(job.rows())
    want = rows(df.where("k IS NULL OR k >= 25"))
    assert set(want) < set(half) < set(rows(df))
    # Rows of batch 4 were written, but not committed.
    job.rows().limit(5).write.parquet(f"{path}/kept/_delete_step=4")
    assert rows(job.rows()) == half
    assert rows(changes.BatchedDelete(spark, path).run()) == want
    steps = job.progress().orderBy("step").collect()
    assert len(steps) == steps[0].steps > 4 and steps[-1].deleted == df.where("k < 25").count()
    assert rows(changes.BatchedDelete(spark, path).run()) == want and job.journal().count() == len(steps)


def test_update_keeps_unmatched_and_takes_null(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    news = spark.createDataFrame([(1, None)], "id int, n string")
    assert rows(changes.update_from_join(df, news, "id", {"v": "n"})) == [(1, None), (2, "b")]


def test_lines_of_files_read_in_blocks(spark, tmp_path):
    texts = {"one.txt": [f"line {i}" * (i % 7) for i in range(3000)], "two.txt": ["", "x", ""]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = text_lines_numbered(str(tmp_path), spark=spark)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 2
        found: dict = {}
        for r in got.orderBy("file", "line_no").collect():
            found.setdefault(os.path.basename(r["file"]), []).append((r["line_no"], r["line"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {name: list(enumerate(lines)) for name, lines in texts.items()}


def test_dump_copy(spark, tmp_path):
    source, target = tmp_path / "dump.sql", str(tmp_path / "out")
    source.write_text("CREATE SCHEMA public;\nSELECT 1;\nDROP SCHEMA IF EXISTS public;\nSET x;\n")
    copy_dump(spark, str(source), target, r"^(DROP|CREATE) SCHEMA( IF EXISTS)? public;")
    assert rows(spark.read.text(target)) == [("SELECT 1;",), ("SET x;",)]


def test_dump_copy_in_bounded_parts(spark, tmp_path):
    """One packed dump becomes parts of at most so many lines, in order, read by several tasks."""
    source, target = tmp_path / "dump.sql.gz", str(tmp_path / "out")
    lines = [f"row {i}" if i % 3 else f"DROP {i}" for i in range(1000)]
    source.write_bytes(gzip.compress("\n".join(lines).encode()))
    copy_dump(spark, str(source), target, "^DROP", lines_per_part=100)
    parts = [f for f in sorted(os.listdir(target)) if f.endswith(".gz")]
    texts = [gzip.decompress((tmp_path / "out" / f).read_bytes()).decode().splitlines() for f in parts]
    assert [len(t) for t in texts] == [100] * 6 + [66]
    assert sum(texts, []) == [line for line in lines if line[0] == "r"]
    index = dump_parts(spark, target).orderBy("part").collect()
    assert [(r["filename"], r["size"]) for r in index] == [(f, os.path.getsize(f"{target}/{f}")) for f in parts]
    assert [(r["part"], r["first_byte"]) for r in index] == [(i, sum(x["size"] for x in index[:i])) for i in range(7)]
    joined = b"".join((tmp_path / "out" / f).read_bytes() for f in parts)
    assert gzip.decompress(joined).decode().splitlines() == sum(texts, [])
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 * 1024 * 1024))
    try:
        tasks = spark.read.text(target).select(F.spark_partition_id().alias("t")).distinct().count()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert tasks == 7


def test_files_and_numbered_tables(spark, tmp_path):
    for name, n in (("house1", 1), ("house12", 2), ("house", 9), ("houseint3", 9), ("old_house4", 9)):
        spark.range(n).write.parquet(str(tmp_path / name))
    assert tables.read_numbered_files(spark, str(tmp_path), "house").count() == 3
    named = {"t2": spark.range(1), "t10": spark.range(2), "t": spark.range(5), "t1x": spark.range(5)}
    saved = tables.union_numbered_tables(named, "t", scratch_path(spark, "numbered"))
    assert saved.count() == 3
    (tmp_path / "flat").mkdir()
    for name, size in (("a.log", 3), ("0b.log", 5)):
        (tmp_path / "flat" / name).write_text("x" * size)
    folder = str(tmp_path / "flat")
    assert [tuple(r) for r in tables.file_listing(folder, spark=spark).collect()] == [("0b.log", 5), ("a.log", 3)]
    assert [r["size"] for r in tables.file_listing(folder, "filename LIKE '0%'", "size", spark).collect()] == [5]


def test_copy_check_sees_a_difference(spark):
    df = spark.createDataFrame([(1, None), (None, "a")], "x int, y string")
    copy, check = tables.table_copy_verified(df, scratch_path(spark, "copy"), "t")
    assert check.first()["same"] and rows(copy) == rows(df)
    swapped = spark.createDataFrame([(1, "a"), (None, None)], "x int, y string")
    assert rows(swapped.agg(*tables.fingerprint(swapped))) != rows(df.agg(*tables.fingerprint(df)))
    odd = df.toDF("a.b", "`c`")
    assert tables.table_copy_verified(odd, scratch_path(spark, "copy"))[1].first()["same"]


def test_groups_come_in_ordered_parts(spark):
    """Two groups over several slices: contiguous parts, never above the limit, the same however dealt."""
    df = spark.range(600).select(
        F.when(F.col("id") < 450, 1).when(F.col("id") < 598, 2).cast("int").alias("g"), F.format_string("%04d", "id").alias("v")
    )
    for slices, files in ((1, 2), (7, 7), (40, 3)):
        got = aggregates.string_agg_distinct(df.union(df).repartition(files), "g", "v", 100, ",", slices=slices).collect()
        for g, low, high in ((1, 0, 450), (2, 450, 598), (None, 598, 600)):
            parts = sorted((r["part"], r["joined"]) for r in got if r["g"] == g)
            assert [p for p, _ in parts] == list(range(-(-(high - low) // 100)))
            assert [len(j.split(",")) for _, j in parts][:-1] == [100] * (len(parts) - 1)
            assert ",".join(j for _, j in parts) == ",".join(f"{i:04d}" for i in range(low, high))
        objects = aggregates.json_object_agg(df, "g", "v", "g", values_per_part=100, slices=slices).where("g = 1")
        sizes = objects.select("part", F.size(F.from_json("object", "map<string,int>")).alias("n")).orderBy("part").collect()
        assert [tuple(r) for r in sizes] == [(0, 100), (1, 100), (2, 100), (3, 100), (4, 50)]


def test_repeated_values_are_cut_as_well(spark):
    df = spark.range(100_003).select(F.lit("g").alias("g"), F.when(F.col("id") < 3, "a").otherwise("b").alias("v"))
    got = aggregates.string_agg_distinct(df, "g", "v", 40_000, ",", distinct=False).orderBy("part").collect()
    assert [r["joined"].count(",") + 1 for r in got] == [40_000, 40_000, 20_003]
    assert got[0]["joined"].startswith("a,a,a,b") and set(got[2]["joined"]) == {"b", ","}


def test_ordered_report(spark):
    df = spark.createDataFrame([("b", 1), ("b", 2), ("z", 3)], "name string, v int")
    got = [tuple(r) for r in joins.ordered_lookup_report(["# head", "b", "a"], df, "name").collect()]
    assert got == [(1, "# head", None), (2, "b", 1), (2, "b", 2), (3, "a", None)]
