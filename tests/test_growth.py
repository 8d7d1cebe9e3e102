"""Steps whose work, memory or driver share grew faster than the tables (round 3), on rows of their own."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from tablewright.functions import versions
from tablewright.operators import hierarchy, joins, json_tables, paging
from tablewright.operators.ranges import range_join
from tablewright.streaming.log_gap import write_log_gap


def shown(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_points_folded_per_interval(spark):
    """Copies of points and intervals, NULL points, bounds and measures, empty and turned intervals; several slices."""
    rng = random.Random(8)
    some = lambda: rng.choice([None, rng.randrange(-3, 60)])
    points = [(rng.choice([None, 7, 7, rng.randrange(50)]), 1, some()) for _ in range(200)]
    spans = [(i % 30, some(), some()) for i in range(60)] + [(0, None, None)] * 3
    a, b = spark.createDataFrame(points, "p int, n long, top long"), spark.createDataFrame(spans, "span int, lo int, hi int")
    for bins in (None, 5):
        got = range_join(a, "p", b, "lo", "hi", bins=bins, folds={"n": F.sum, "top": F.max}).collect()
        want = []
        for s, lo, hi in spans:
            held = [(n, top) for p, n, top in points if p is not None and (lo is None or lo <= p) and (hi is None or p < hi)]
            if held:
                want.append((s, lo, hi, len(held), max((top for _, top in held if top is not None), default=None)))
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert range_join(a.limit(0), "p", b, "lo", "hi", folds={"n": F.sum}).collect() == []


def test_folded_ties_of_the_key(spark):
    """Versions whose text keys tie are told apart by their exact keys."""
    texts = ["1." + "a" * 9 + end for end in ("a", "b", "c", "d")] + ["1.2", "0.x"]
    a = spark.createDataFrame([(t, 1) for t in texts], "v string, n long")
    b = spark.createDataFrame([(texts[1], texts[3]), (texts[0], None), ("1.2", texts[1])], "low string, high string")
    key, sort = versions.version_text_key, versions.version_sort_key
    points = a.select("n", key("v").alias("at"), sort("v").alias("exact"))
    ranges = b.select("*", key("low").alias("f"), key("high").alias("t"), sort("low").alias("fe"), sort("high").alias("te"))
    ranges = ranges.withColumn("t", F.when(F.col("high").isNotNull(), F.col("t")))
    got = range_join(points, "at", ranges, "f", "t", folds={"n": F.sum}, ties=("exact", "fe", "te"))
    exact = {t: [tuple(x) for x in r.s] for t, r in zip(texts, a.select(sort("v").alias("s")).collect())}
    want = set()
    for low, high in [(texts[1], texts[3]), (texts[0], None), ("1.2", texts[1])]:
        n = sum(exact[low] <= exact[t] and (high is None or exact[t] < exact[high]) for t in texts)
        want |= {(low, n)} if n else set()
    assert {(r.low, r.n) for r in got.collect()} == want


def test_wide_intervals_make_no_pairs(spark):
    """Each of 60,000 intervals holds most of 300,000 points: some 10^10 pairs."""
    points = spark.range(300_000).select("id", F.lit(1).cast("long").alias("n"))
    spans = spark.range(60_000).select((F.col("id") % 7).alias("lo"), (F.col("id") + 200_000).alias("hi"))
    got = range_join(points, "id", spans, "lo", "hi", bins=16, folds={"n": F.sum})
    assert got.where("n <> hi - lo").count() == 0 and got.count() == 60_000


def test_lone_keys_by_one_grouping(spark):
    """Copies and NULL keys come out as often as they stand there; no side is joined to the other."""
    a = spark.createDataFrame([(k,) for k in [1, 1, 2, 3, 3, None, None, 5]] + [(9,)] * 10_001, "k int")
    b = spark.createDataFrame([(k,) for k in [2, 2, 4, 4, 5, None]], "j long")
    got = joins.one_sided_keys(a, b, ("k", "j"))
    want = [(1, "left")] * 2 + [(3, "left")] * 2 + [(None, "left")] * 2 + [(9, "left")] * 10_001
    want += [(4, "right")] * 2 + [(None, "right")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    plan = shown(joins.one_sided_keys(a, b, ("k", "j")))
    assert "Join" not in plan and plan.count("Scan") == 2


def test_rounds_bring_nothing_to_the_driver(spark, monkeypatch):
    """Small links are not broadcast in each round of the closure."""
    plans, cut = [], hierarchy.cut_lineage

    def spy(df):
        out = cut(df)
        plans.append(shown(df))
        return out

    monkeypatch.setattr(hierarchy, "cut_lineage", spy)
    edges = spark.range(1, 60).selectExpr("id AS m", "id div 2 AS r")
    assert hierarchy.membership_closure(edges, "m", "r").count() == sum(n.bit_length() for n in range(1, 60))
    rounds = [p for p in plans if "Join" in p]
    assert rounds and not any("Broadcast" in p for p in rounds)


def test_documents_are_made_for_the_answer_only(spark):
    """Rows that one side lacks are found before their documents are made, changed ids once."""
    one = spark.createDataFrame([(i, '{"a": %d}' % i) for i in range(9)], "id int, j string")
    two = spark.createDataFrame([(i, '{"a": %d}' % (i + i % 2)) for i in range(2, 11)], "id int, j string")
    got = json_tables.table_diff_deep_limited(one, two, "id", limit=2, json_cols=["j"])
    plan = shown(got)
    assert [(r.id, r.change_path) for r in got.collect()] == [
        (0, "<two row missing>"), (1, "<two row missing>"), (3, ".j"), (3, ".j.a"), (5, ".j"), (5, ".j.a"),
        (9, "<one row missing>"), (10, "<one row missing>"),
    ]
    assert "sha2" not in plan and "LeftAnti" in plan
    assert all("parse_json" not in line for line in plan.split("LeftAnti", 1)[1].splitlines() if "Scan" in line)


def test_joins_of_a_deep_page_run_twice(spark, monkeypatch):
    """The order columns of joined tables are written once; borders and counts come from them."""
    seen, bounds = [], paging.slice_bounds
    monkeypatch.setattr(paging, "slice_bounds", lambda df, *rest: seen.append(shown(df)) or bounds(df, *rest))
    a = spark.createDataFrame([(i % 50, i) for i in range(400)], "k int, v int")
    star = joins.star_join(a, [(spark.range(50).withColumnRenamed("id", "d"), F.col("k") == F.col("d"))])
    got = paging.deep_page(star, ["k", "v"], 5, lambda rows: rows * 2 // 3, joined=True).collect()
    want = sorted((i % 50, i) for i in range(400))[266:271]
    assert [(r.k, r.v) for r in got] == want and [r.position for r in got] == list(range(266, 271))
    assert seen and not any("Join" in plan for plan in seen)


@pytest.mark.parametrize("delay", [None, "20 seconds"])
def test_stream_state_by_buckets(spark, tmp_path, delay):
    """Many keys share few states; keys and ties beyond 2^53 and NULL ones come through unchanged."""
    start, big, folder = 1_700_000_000, 2**60, str(tmp_path / "in")
    rows = [(big + i, None if i % 3000 == 7 else big + i % 3000, start + i // 100) for i in range(6000)]
    for part in (rows[:3000], rows[3000:] + [(None, None, start + 10_000)]):
        some = spark.createDataFrame(part, "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
        some.drop("s").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    query = write_log_gap(stream, "user_id", "ts", "event_id", str(tmp_path / "out"), str(tmp_path / "state"), delay)
    out = spark.read.parquet(str(tmp_path / "out")).where("event_id IS NOT NULL").collect()
    assert sorted((r.event_id, r.user_id, r.gap_us) for r in out) == [(e, u, 30_000_000 if e - big >= 3000 else None) for e, u, _ in rows]
    states = [s.numRowsTotal for p in query.recentProgress for s in p.stateOperators]
    assert 0 < max(states) <= 512
