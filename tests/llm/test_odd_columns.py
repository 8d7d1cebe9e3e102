"""Operators that pass rows on, with columns of awkward names, null and repeated ids, and no rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import sharding, toxicity
from tablewright.llm.decontamination import drop_contaminated
from tablewright.llm.graph import components
from tablewright.llm.mixing import Mix
from tablewright.llm.near_duplicates import drop_near_duplicates
from tablewright.llm.sharding import shard_dataset
from tests.llm.data import documents, odd_rows, table

ODD = ["a.b", "_Toxicity", "SCORE", "tie", "base", "part", "Row", "_tie", "a c", "_copy"]


def odd_table(spark, rows):
    df = table(spark, rows)
    return df.select("*", *[F.lit(f"{n}!").alias(n) for n in ODD])


def items(spark):
    return spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 wa wb wc wd we"), (2, None)], "item_id long, text string")


STAGES = {
    "toxicity": lambda spark, df, path: toxicity.drop_toxic(df, toxicity.pickle.dumps(None)),
    "near_dedup": lambda spark, df, path: drop_near_duplicates(df),
    "decontamination": lambda spark, df, path: drop_contaminated(df, items(spark)),
    "mixing": lambda spark, df, path: Mix(df, block_words=16).documents(df),
    "sharding": lambda spark, df, path: shard_dataset(df, path, shards=4, bucket_bytes=4000),
}


@pytest.mark.parametrize("stage", STAGES)
def test_all_columns_come_through(spark, tmp_path, stage):
    for i, rows in enumerate((odd_rows(), [])):
        df = odd_table(spark, rows)
        out = STAGES[stage](spark, df, str(tmp_path / str(i)))
        assert out.columns[: len(df.columns)] == df.columns
        back = out.toDF(*[f"c{k}" for k in range(len(out.columns))]).collect()
        assert all(tuple(r)[5 : len(df.columns)] == tuple(f"{n}!" for n in ODD) for r in back)
        known = Counter(map(repr, rows))
        got = Counter(repr(tuple(r)[:5]) for r in back)
        assert set(got) <= set(known)
        if stage in ("toxicity", "sharding"):
            assert got == known


def test_copies_of_one_row_are_spread(spark, tmp_path):
    """Copies beyond a bucket's size go to several buckets of their shard, whole and gapless."""
    rows = [(7, "word " * 50, "en", "a", 250)] * 1200 + documents(3, 40)
    out = shard_dataset(table(spark, rows), str(tmp_path / "out"), shards=2, bucket_bytes=20_000).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in rows)
    sizes = Counter()
    for r in out:
        sizes[r.bucket] += len((r.text or "").encode()) + 1
    assert max(sizes.values()) < 100_000 and len({r.shard for r in out if r.doc_id == 7}) == 1
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    again = shard_dataset(table(spark, rows[::-1]).repartition(7), str(tmp_path / "again"), shards=2, bucket_bytes=20_000).collect()
    key = lambda r: (r.shard, r.slot, r.doc_id, r.text, r.bucket)
    assert Counter(map(key, again)) == Counter(map(key, out))


def test_the_toxic_part_of_a_long_text_is_learned(spark):
    """Windows of a training text are all seen: no gaps, however long it is."""
    types = toxicity.Types([b" ".join(b"w%d" % i for i in range(12_000))])
    assert len(set(types.windows.ravel().tolist())) == 12_000 and not hasattr(toxicity, "TRAIN_WINDOWS")


def test_hubs(spark):
    """A star of many links, a path and a ring: the smallest node of each."""
    links = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(40)] + [(9000 + i, 9000 + (i + 1) % 50) for i in range(50)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(3000)} | {i: 5000 for i in range(5000, 5041)} | {i: 9000 for i in range(9000, 9050)}
    assert found == want


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null and repeated ids, repeated rows and odd columns in one run; then no rows at all."""
    for name, rows in (("rows", odd_rows()), ("none", [])):
        folder = tmp_path / name
        odd_table(spark, rows).write.parquet(str(folder / "documents.parquet"))
        items(spark).write.parquet(str(folder / "benchmark.parquet"))
        spark.createDataFrame([(r[0], 0, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(folder)).select("doc_id", "text", "slot", "shard", "`a.b`").collect()
        assert {(r.doc_id, r.text) for r in out} <= {(r[0], r[1]) for r in rows} and (not rows or len(out) > 10)
        assert len({(r.shard, r.slot) for r in out}) == len(out) and {r["a.b"] for r in out} <= {"a.b!"}
