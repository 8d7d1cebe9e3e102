"""Written tables, batch sizes, and connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import scratch_path


ROWS_PER_BATCH, COMMON_ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
SALTS = 16
BYTES_PER_BATCH, COMMON_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
ROWS_PER_READ, COMMON_READ = "spark.sql.parquet.columnarReaderBatchSize", "4096"


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python tasks by 1,000 rows, unless the session has chosen another number."""
    if spark.conf.get(ROWS_PER_BATCH, COMMON_ROWS_PER_BATCH) == COMMON_ROWS_PER_BATCH:
        spark.conf.set(ROWS_PER_BATCH, "1000")


def few_bytes(spark: SparkSession) -> None:
    """Read large rows by 512 and hand them to Python tasks by 8 MB, unless the session has chosen other numbers."""
    if spark.conf.get(BYTES_PER_BATCH, COMMON_BYTES) == COMMON_BYTES:
        spark.conf.set(BYTES_PER_BATCH, str(8 << 20))
    if spark.conf.get(ROWS_PER_READ, COMMON_READ) == COMMON_READ:
        spark.conf.set(ROWS_PER_READ, "512")


def stored(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """``df`` written to the shared folder, with ``options`` of the writer, and read back: the lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, component for every node of ``links`` (a, b): the smallest node that it reaches.

    ``known`` is the result for earlier links, to go on from: its nodes are in the result, and only their
    components are joined, so that few new links take few rounds.

    A round hangs the neighbours of a node on the smallest of them, first the larger ones (large star),
    then the smaller ones (small star); rounds grow with the logarithm of the diameter. Each round is
    written to the shared folder; the driver sees whether all is done. Minima are combined
    before the shuffle, and go back to the edges over ``SALTS`` parts of each node, so that a hub's edges
    never meet in one task.
    """
    if known is not None:
        for side in "ab":
            links = links.join(known.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
        links = links.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = stored(_few_parts(ends.distinct()), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = _met(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # The node itself and its neighbours hang on the smallest neighbour.
        hung = _met(large, low).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = stored(_few_parts(hung.where("u <> v").distinct()), "edges")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    # An edge leads to a root, and a root leads nowhere.
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = leaves.unionByName(roots)
    if known is not None:
        moved = found.select(F.col("node").alias("component"), F.col("component").alias("to"))
        rows = known.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        # The smallest node of a known component stands on both sides.
        found = rows.unionByName(found).distinct()
    return stored(_few_parts(found), "components")


def _few_parts(rows: DataFrame) -> DataFrame:
    """Rows of a round in a few partitions for each core, however many the shuffles have: rounds are small."""
    return rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _met(edges: DataFrame, minima: DataFrame) -> DataFrame:
    """Edges (u, v) with the value of u; u is dealt out by a hash of v."""
    part = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return edges.withColumn("part", part).join(minima.withColumn("part", parts), ["u", "part"]).drop("part")


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge at most that leads on, and leads to a node without."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.where("out > 1 OR (out = 1 AND into = 1)").isEmpty()
