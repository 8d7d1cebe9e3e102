"""Table change jobs: each gives the table as it should be afterwards."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import format_interval, template_render
from tablewright.session import cut_lineage

_STEP, _DOOMED = "_delete_step", "_doomed"


def duplicate_status(df: DataFrame, id_col: str, golden_key: str, name: str = "duplicate_status") -> DataFrame:
    """2 where another row points to this one, else 3 where it points to a golden record, else 1."""
    pointed = df.select(F.col(golden_key).alias("_golden")).where("_golden IS NOT NULL").distinct()
    joined = df.join(pointed, df[id_col] == pointed["_golden"], "left")
    status = F.when(F.col("_golden").isNotNull(), 2).when(F.col(golden_key).isNotNull(), 3).otherwise(1)
    return joined.withColumn(name, status).drop("_golden")


def resolve_chains(pairs: DataFrame, old: str = "old_key", new: str = "new_key") -> DataFrame:
    """(new, old) pairs made one-to-one, with chains followed to their last survivor.

    Every round doubles the length of the links, so a chain of n takes about log2(n) rounds. A cycle
    has no survivor and is an error.
    """
    links = cut_lineage(
        pairs.where(F.col(old) != F.col(new)).groupBy(F.col(new).alias("new_key")).agg(F.min(old).alias("old_key"))
    )
    rounds = 2 + math.ceil(math.log2(links.count() + 1))
    for _ in range(rounds):
        onward = links.select(F.col("new_key").alias("_from"), F.col("old_key").alias("_to"))
        jumped = links.join(onward, links["old_key"] == onward["_from"], "left")
        if jumped.where("_to IS NOT NULL").isEmpty():
            return links
        links = cut_lineage(jumped.select("new_key", F.coalesce("_to", "old_key").alias("old_key")))
    raise ValueError("the pairs form a cycle")


def key_remap_cascade(
    pairs: DataFrame,
    children: Mapping[str, tuple[DataFrame, str]],
    parent: DataFrame,
    key: str,
    origin: tuple[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Replace new keys by their survivors in all child tables and drop the replaced parents.

    ``pairs`` has ``old_key`` (stays) and ``new_key`` (goes); ``children`` maps a name to a table and
    its key column. With ``origin=(target, source)`` a surviving parent takes ``target`` from
    ``source``. The result holds the children by name and the parent under ``parent``.
    """
    links = cut_lineage(resolve_chains(pairs))
    out = {}
    for name, (child, column) in children.items():
        joined = child.join(links, child[column] == links["new_key"], "left")
        out[name] = joined.withColumn(column, F.coalesce("old_key", column)).drop("old_key", "new_key")
    gone = links.select("new_key")
    left = parent.join(gone, parent[key] == gone["new_key"], "left_anti")
    if origin is not None:
        target, source = origin
        kept = links.select(F.col("old_key").alias("_kept")).distinct()
        left = left.join(kept, left[key] == kept["_kept"], "left")
        left = left.withColumn(target, F.when(F.col("_kept").isNotNull(), F.col(source)).otherwise(F.col(target)))
        left = left.drop("_kept")
    out["parent"] = left
    return out


class BatchedDelete:
    """A delete in bounded batches that can stop anywhere and go on later.

    The table is dealt out once by a hash of its key into one folder per batch, hot ones over several
    files; each batch then rewrites its own folder without the target keys and is committed by a row of
    the journal. What has no journal row counts as not done: a batch that failed halfway is written anew,
    and until then its rows stay. Null keys are never deleted.

    ``path`` holds everything; an object made on a path that has a plan goes on with that plan.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def plan(cls, df: DataFrame, targets: DataFrame, key: str, path: str, batch: int = 10_000) -> BatchedDelete:
        """Deal out ``df``; a batch deletes about ``batch`` rows. The plan row is written last."""
        job = cls(df.sparkSession, path)
        doomed = targets.select(F.col(key).alias(_DOOMED)).where(F.col(_DOOMED).isNotNull()).distinct()
        total = df.join(doomed, df[key] == doomed[_DOOMED], "left_semi").count()
        steps = max(1, math.ceil(total / batch))

        def dealt(rows: DataFrame, column: str, name: str) -> None:
            step = F.pmod(F.xxhash64(column), F.lit(steps)).cast("int") + 1
            rows = rows.withColumn(_STEP, step).hint("rebalance", F.col(_STEP))
            rows.write.mode("overwrite").partitionBy(_STEP).parquet(f"{job.path}/{name}")

        dealt(doomed, _DOOMED, "targets")
        dealt(df, key, "rows")
        held = job._part("rows", T.StructType([*df.schema.fields, T.StructField(_STEP, T.IntegerType())])).groupBy(_STEP).count()
        sizes = {r[_STEP]: r["count"] for r in held.collect()}
        shape = [(steps, total, key, df.schema.json(), doomed.schema.json(), sizes)]
        columns = "steps int, total long, key string, rows string, targets string, sizes map<int, long>"
        plan = job.spark.createDataFrame(shape, columns)
        plan.coalesce(1).write.mode("overwrite").parquet(f"{job.path}/plan")
        return job

    def _plan(self):
        row = self.spark.read.parquet(f"{self.path}/plan").first()
        schemas = [T.StructType.fromJson(json.loads(x)).add(_STEP, T.IntegerType()) for x in (row.rows, row.targets)]
        return row.steps, row.total, row.key, *schemas, row.sizes

    def _part(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def journal(self) -> DataFrame:
        """step, deleted, kept, ms of the committed batches."""
        schema = "step int, deleted long, kept long, ms long"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/journal")
        except AnalysisException:  # no batch has been committed
            return self.spark.createDataFrame([], schema)

    def run(self, most: int | None = None) -> DataFrame:
        """Do the batches that the journal lacks, ``most`` of them at most; gives :meth:`rows`."""
        steps, total, key, rows, targets, sizes = self._plan()
        done = {r.step for r in self.journal().select("step").collect()}
        for step in [s for s in range(1, steps + 1 if total else 1) if s not in done][:most]:
            began = time.monotonic()
            here = self._part("rows", rows).where(F.col(_STEP) == step).drop(_STEP)
            doomed = self._part("targets", targets).where(F.col(_STEP) == step).drop(_STEP)
            seen = Observation()
            kept = here.join(doomed, here[key] == doomed[_DOOMED], "left_anti").observe(seen, F.count("*").alias("kept"))
            kept.write.mode("overwrite").parquet(f"{self.path}/kept/{_STEP}={step}")
            left = seen.get["kept"]
            entry = [(step, sizes.get(step, 0) - left, left, int((time.monotonic() - began) * 1000))]
            marker = self.spark.createDataFrame(entry, "step int, deleted long, kept long, ms long")
            marker.coalesce(1).write.mode("append").parquet(f"{self.path}/journal")
        return self.rows()

    def rows(self) -> DataFrame:
        """The table as it stands: committed batches as rewritten, the others untouched."""
        steps, _, _, rows, *_ = self._plan()
        done = [r.step for r in self.journal().select("step").collect()]
        open_rows = self._part("rows", rows).where(~F.col(_STEP).isin(done)).drop(_STEP)
        if not done:
            return open_rows
        kept = self._part("kept", rows).where(F.col(_STEP).isin(done)).drop(_STEP)
        return kept if len(done) == steps else kept.unionByName(open_rows)

    def progress(self) -> DataFrame:
        """Per committed batch: step, steps, deleted so far, total, done_percent, ms.

        Steps count in the order of the journal's step numbers; there are as many rows as batches.
        """
        steps, total, *_ = self._plan()
        sofar = F.sum("deleted").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
        return self.journal().select(
            F.col("step").cast("long").alias("step"),
            F.lit(steps).cast("long").alias("steps"),
            sofar.alias("deleted"),
            F.lit(total).cast("long").alias("total"),
            F.round(F.col("step") / F.lit(steps) * 100, 2).alias("done_percent"),
            "ms",
        )


def batched_delete(df: DataFrame, targets: DataFrame, key: str, path: str, batch: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The rows left after deleting those with a target key, batch by batch, and the progress rows."""
    job = BatchedDelete.plan(df, targets, key, path, batch)
    return job.run(), job.progress()


def batch_progress_log(progress: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Progress rows with their times: estimated rest by the last two batches, and a line of text.

    ``durations`` has ``step`` and ``ms``; without it, ``progress`` has its own ``ms``. A step without a
    time stays, without an estimate; a step without a predecessor counts itself.
    """
    if durations is None:
        progress, durations = progress.drop("ms"), progress.select("step", "ms")
    before = durations.select((F.col("step") + 1).alias("step"), F.col("ms").alias("_before"))
    timed = progress.join(durations, "step", "left").join(before, "step", "left")
    mean = F.floor((F.col("ms") + F.coalesce("_before", "ms")) / 2)
    timed = timed.withColumn("eta_ms", ((F.col("steps") - F.col("step")) * mean).cast("bigint")).drop("_before")
    line = template_render(
        "step ${step} of ${steps}: ${deleted} of ${total} rows gone (${done} percent) after ${spent}, ${eta} to go",
        {
            "spent": format_interval("ms"),
            "eta": format_interval("eta_ms"),
            "step": "step",
            "steps": "steps",
            "done": "done_percent",
            "deleted": "deleted",
            "total": "total",
        },
        escape_percent=False,
    )
    return timed.withColumn("message", line)


def update_from_join(df: DataFrame, changes: DataFrame, key: str, set: Mapping[str, str]) -> DataFrame:
    """``UPDATE ... FROM``: matched rows take the new values, NULL included; others stay.

    ``set`` maps a column to the column of ``changes`` it is taken from. Of several changes of a key
    the largest counts, chosen before the join.
    """
    pick = F.max(F.struct(*[F.col(source).alias(f"_new_{c}") for c, source in set.items()])).alias("_new")
    latest = changes.groupBy(F.col(key).alias("_key")).agg(pick)
    joined = df.join(latest, df[key] == latest["_key"], "left")
    for c in set:
        joined = joined.withColumn(c, F.when(F.col("_key").isNotNull(), F.col("_new")[f"_new_{c}"]).otherwise(F.col(c)))
    return joined.drop("_key", "_new")
