"""Two-pass external shuffle into shards.

Pass 1 scatters records by seeded hashes into buckets that fit in a task's memory. Pass 2 puts each
bucket in an order of its own by a seeded Fisher-Yates shuffle and writes it; the buckets of a shard,
one after the other, are the shard.

The law that holds is ``key``: doc_id and the number of shards decide the shard. Each shard s gives
doc_id a score from a hash of (s, doc_id) and the highest score wins (highest random weight), so with
one shard more a row either stays or goes to the new shard. Counts and sizes are as near equal as
hashes make them.

Defined results: rows with one doc_id, null included, share a shard, but are spread over its buckets
by a hash of their other columns; rows that agree in all columns are interchangeable, and where they are
more than a bucket holds, they are numbered and spread over buckets by their numbers. A null text has size 1 and the checksum of the empty text. An empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.graph import stored

RESERVED = ("shard", "bucket", "slot", "grown_shard")


def shard_of(doc_id: Column, shards: int, seed: int = 0) -> Column:
    """The shard from 0 to ``shards`` - 1 with the highest score for ``doc_id``."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    scores = [
        F.struct(F.xxhash64(F.lit(seed), F.lit(s), doc_id).alias("score"), F.lit(s).alias("shard"))
        for s in range(shards)
    ]
    return (F.greatest(*scores) if shards > 1 else scores[0])["shard"]


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _holds_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString()


def _order(bucket: int, rows: int, seed: int) -> np.ndarray:
    """Fisher-Yates over 0 .. rows - 1, the same for the same bucket and seed."""
    order = np.arange(rows)
    np.random.default_rng([seed, bucket]).shuffle(order)
    return order


def shard_dataset(
    docs: DataFrame, path: str, shards: int = 16, seed: int = 0, bucket_bytes: int = 8 << 20, grow: bool = False
) -> DataFrame:
    """Write ``docs`` (doc_id, text and any other columns) to ``path``, partitioned by shard; read it back.

    Rows get ``slot``, their place in the shard, gapless from 0, and ``bucket``; files hold whole
    buckets in slot order. With ``grow`` they also get ``grown_shard``, their shard if there were one
    more. Columns that bear one of these names in the input are replaced. ``bucket_bytes`` is the
    mean text size of a bucket and the bound of a task's memory; the number of buckets follows from
    the size of all rows.
    """
    keep = [c for c in docs.columns if c.lower() not in RESERVED]
    taken = {c.lower() for c in docs.columns}
    tie, copy, part, base = (next(n for n in _names(x) if n not in taken) for x in ("_tie", "_copy", "_part", "_base"))
    rows = docs.select(*["`" + c.replace("`", "``") + "`" for c in keep])
    keyed = rows.withColumn("shard", shard_of(F.col("doc_id"), shards, seed))
    if grow:
        keyed = keyed.withColumn("grown_shard", shard_of(F.col("doc_id"), shards + 1, seed))
    size = size_of(F.col("text"))
    total = docs.agg(F.sum(size)).first()[0] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    whole = ["`" + f.name.replace("`", "``") + "`" for f in rows.schema if not _holds_map(f.dataType)]
    keyed = keyed.withColumn(tie, F.xxhash64(F.lit(seed + 1), *whole))
    many = stored(
        keyed.groupBy(tie).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))
        .where(F.col("bytes") > bucket_bytes).select(tie, F.greatest(F.lit(1), F.floor(F.col("rows") * bucket_bytes / F.col("bytes"))).alias(copy)),
        "many-copies",
    )
    spread = F.col(tie)
    if not many.isEmpty():
        keyed = _numbered_copies(keyed, many, tie, copy, part, base)
        spread = F.when(F.col(copy).isNull(), F.col(tie)).otherwise(F.xxhash64(tie, copy))
    keyed = keyed.withColumn("bucket", F.col("shard").cast("long") * per_shard + F.pmod(spread, F.lit(per_shard)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        keyed.groupBy("bucket", "shard")
        .agg(F.count("*").alias("rows"))
        .select("bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(base))
    )
    # Names that Spark would take for paths do not reach the task.
    plain, made = [f"c{i}" for i in range(len(keep))], [*(["grown_shard"] if grow else []), "shard", "bucket"]
    named = [F.col("`" + c.replace("`", "``") + "`").alias(p) for c, p in zip(keep, plain)]
    ready = keyed.join(bases, "bucket").select(*named, *made, F.col(tie).alias("tie"), F.col(base).alias("base"))
    doc_id, columns = plain[keep.index("doc_id")], [*plain, *made, "slot"]
    schema = T.StructType([*(ready.schema[c] for c in columns[:-1]), T.StructField("slot", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(doc_id, "ascending"), ("tie", "ascending")])
        rows = table.num_rows
        table = table.take(_order(table.column("bucket")[0].as_py(), rows, seed))
        first = table.column("base")[0].as_py()
        return table.append_column("slot", pa.array(np.arange(first, first + rows), pa.int64())).select(columns)

    out = ready.groupBy("bucket").applyInArrow(run, schema).toDF(*keep, *made, "slot")
    out.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def _names(name: str):
    while True:
        yield name
        name += "_"


def _numbered_copies(keyed: DataFrame, many: DataFrame, tie: str, copy: str, part: str, base: str) -> DataFrame:
    """``keyed`` with ``copy``: for rows of the ties of ``many`` (tie, copies in a bucket) the number of the
    bucket's worth of copies that the row is in, else null. Copies are written out and counted by parts."""
    known = keyed.join(many, tie, "left").withColumn(part, F.when(F.col(copy).isNotNull(), F.spark_partition_id()))
    hot = stored(known.where(F.col(copy).isNotNull()), "copied")
    earlier = Window.partitionBy(tie).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(
        hot.groupBy(tie, part).agg(F.count("*").alias("rows"))
        .select(tie, part, F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias(base)),
        "copies",
    )
    local = F.row_number().over(Window.partitionBy(tie, part).orderBy(F.lit(0))) - 1
    numbered = hot.join(bases, [tie, part]).withColumn(copy, F.floor((F.col(base) + local) / F.col(copy))).drop(base)
    return known.where(F.col(copy).isNull()).unionByName(numbered).drop(part)


def shard_digest(shards: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of written shards."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return shards.select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )

