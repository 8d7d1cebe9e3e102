"""Documents to training shards: five stages, each on what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. :func:`run` writes each stage's result as
Parquet to the shared folder and reads it again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.decontamination import drop_contaminated
from tablewright.llm.graph import stored
from tablewright.llm.mixing import Mix
from tablewright.llm.near_duplicates import drop_near_duplicates
from tablewright.llm.sharding import shard_dataset
from tablewright.llm.toxicity import drop_toxic, fit
from tablewright.session import scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. Null and empty texts score 0 and stay."""
    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold=0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8, the one with the smallest doc_id stays."""
    return drop_near_duplicates(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if 13-word windows of benchmark items hit at least a twentieth of their words."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=13, min_share=(1, 20))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that their sources come near their targets in words."""
    return Mix(docs, weights=(5, 2, 1), most=3.0, block_words=128).documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in 16 shards, with their shard, bucket and slot."""
    return shard_dataset(docs, scratch_path(spark, "shards"), shards=16)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

# A trained network scores the first stage, so SQL cannot express the rows; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir.rstrip("/")), name)
    return docs
