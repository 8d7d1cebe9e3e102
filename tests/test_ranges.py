"""Points in intervals, version keys, reachability by pairs and counts from footers."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from tablewright.functions import versions
from tablewright.operators import hierarchy, quality
from tablewright.operators.ranges import range_join
from tablewright.plans import QUERIES


def shown(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("bins", [None, 1, 7, 40])
def test_points_in_intervals(spark, bins):
    """Ties, a hot point, NULL points and bounds, empty and turned intervals, intervals over all bins."""
    rng = random.Random(bins)
    points = [(i, rng.choice([None, 5, 5, 5, rng.randrange(100)])) for i in range(300)]
    spans = [(i, rng.choice([None, rng.randrange(-5, 105)]), rng.choice([None, rng.randrange(-5, 105)])) for i in range(60)]
    a = spark.createDataFrame(points, "id int, p int").repartition(3)
    b = spark.createDataFrame(spans, "span int, lo int, hi int")
    got = sorted((r.id, r.span) for r in range_join(a, "p", b, "lo", "hi", bins=bins).collect())
    want = [(i, s) for i, p in points for s, lo, hi in spans if p is not None and (lo is None or lo <= p) and (hi is None or p < hi)]
    assert got == sorted(want)


def test_no_points_or_no_intervals(spark):
    a, b = spark.createDataFrame([], "id int, p int"), spark.createDataFrame([(1, 2, 3)], "span int, lo int, hi int")
    assert range_join(a, "p", b, "lo", "hi").collect() == []
    assert range_join(spark.createDataFrame([(1, 2)], "id int, p int"), "p", b.limit(0), "lo", "hi").collect() == []


def test_text_keys_keep_version_order(spark):
    rng = random.Random(3)
    texts = ["0.5.5", "0.5.11", "0.18.99", "0.7.28", "0.7.28release", "0.7.28-release", "0.7.28тест", "", "x", "1.-1", "01", "1", "99999999999", "1.2147483647", "a" * 20, "a" * 19 + "b"]
    texts += [".".join(rng.choice(["1", "2", "10", "rc1", "b", "07"]) for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    rows = df.select("v", versions.version_text_key("v").alias("k"), versions.version_sort_key("v").alias("s")).collect()
    assert len({len(r.k) for r in rows}) == 1
    in_order = sorted(rows, key=lambda r: [tuple(x) for x in r.s])
    assert [r.k.encode() for r in in_order] == sorted(r.k.encode() for r in rows)


def test_version_ranges_meet_by_bins(spark):
    plan = shown(QUERIES["version_range_join"](spark, "/root/testdata/sf0.01"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_dense_layers(spark):
    """Twenty layers of eight nodes, each joined to all of the next: 8^19 paths, but few pairs."""
    edges = [(8 * a + i, 8 * (a + 1) + j) for a in range(19) for i in range(8) for j in range(8)]
    got = hierarchy.reachable_pairs(spark.createDataFrame(edges, "m int, r int"), "m", "r")
    assert {tuple(r) for r in got.collect()} == {(x, y) for x in range(160) for y in range(160) if x // 8 < y // 8}


def test_pairs_are_those_of_the_paths(spark):
    """Cycles, loops on a node, two ways between nodes, lone nodes."""
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "y"), ("x", "z"), ("y", "w"), ("z", "w"), ("a", "b")]
    df, nodes = spark.createDataFrame(edges, "m string, r string"), spark.createDataFrame([(n,) for n in "abcdxyzwq"], "n string")
    closure = hierarchy.membership_closure(df, "m", "r", nodes).where("role IS NULL OR member <> role").select("member", "role")
    got = hierarchy.reachable_pairs(df, "m", "r", nodes)
    key = lambda rows: sorted({tuple(r) for r in rows}, key=repr)
    assert key(got.collect()) == key(closure.collect()) and got.count() == got.distinct().count()
    grants = spark.createDataFrame([("a", "t1"), ("w", "t2"), ("w", "t2"), ("q", "t3")], "grantee string, t string")
    paths = hierarchy.effective_grants(df, nodes, grants, "m", "r").where("role IS NULL OR member <> role").drop("path").distinct()
    pairs = hierarchy.effective_grants(df, nodes, grants, "m", "r", paths=False)
    assert key(pairs.collect()) == key(paths.collect()) and pairs.count() == len(key(paths.collect()))
    assert hierarchy.reachable_pairs(df.limit(0), "m", "r").collect() == []


def test_counts_come_from_footers(spark, tmp_path):
    spark.range(500).withColumn("s", F.struct("id")).repartition(3).write.parquet(str(tmp_path / "a"))
    spark.range(0).write.parquet(str(tmp_path / "b"))
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    got = quality.footer_row_counts(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")})
    assert {tuple(r) for r in got.collect()} == {("a", 500), ("b", 0)}
    assert shown(got).count("PushedAggregation: [COUNT(*)]") == 2
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
