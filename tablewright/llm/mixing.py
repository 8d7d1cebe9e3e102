"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

The words of a source are laid out as a stream: its documents in a seeded hash order, cut into blocks
of ``block_words`` words (the last one may be shorter), or of an eighth of the source's target where that
is less, so that rounding to whole blocks leaves no source with a target of a word or more out. A schedule of slots says which source gives
the next block: slot s of 2^m maps the van der Corput point of s (its bits reversed) through the
cumulative weights of the sources. A weight is the whole number of blocks that the source's target
needs, so over the whole schedule every source gets exactly its blocks, and over any part of it nearly
its share. The slots of a source, ranked in schedule order, take its blocks in stream order and start
again after the last one.

Sizes are counts of words. Sources are weighed in code point order, null last, and share all words by
their weights; a target stops at ``most`` times the size of its source and the excess is shared again
by weight. The limit point of that is found directly: with sources sorted by cap over weight, the
first ones are capped, and the rest share what is left.

Defined results: a null text has size 0; a document of size 0 is taken 0 times; a source of size 0 has
target 0; documents that agree in all columns are interchangeable; an empty table gives no rows. The
stream order is cut into hash ranges of about ``rows_per_part`` documents, so that a source with most
rows is not laid out in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
SLOTS_PER_PART = 1 << 14
MOST_BROADCAST = 100_000
LEAST_SLOTS = 8


def _tie(docs: DataFrame) -> Column:
    """Hash of a whole row, which tells rows with one doc_id apart."""
    return F.xxhash64(*[f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()])


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``target`` added to a table (source, rows, source_size) of one row per source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.get(cycle, F.pmod(place, F.lit(len(weights))).cast("int")))
    weighed = weighed.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # Sources from the tightest cap on.
    tight = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    after = tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = tight.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    open_level = weighed.withColumn("level", level).withColumn("place", F.row_number().over(tight)).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    # From the first free source on, all are free and share the level found there.
    shared = F.min(F.when(F.col("free"), F.struct("place", "level")))
    level_of_free = shared.over(whole)["level"]
    target = F.when(F.col("free"), level_of_free * F.col("weight")).otherwise(F.col("cap"))
    return open_level.withColumn("target", target.cast("double")).select("source", "rows", "source_size", "target")


def with_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Rows with the values of their source; a table of up to 100,000 sources is broadcast."""
    right = per_source.withColumnRenamed("source", "_source")
    if per_source.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        right = F.broadcast(right)
    return rows.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def stream(docs: DataFrame, counts: DataFrame, seed: int = 0, rows_per_part: int = 2_000) -> DataFrame:
    """``docs`` (source, size and others) with ``start``, their first word's place in their source's
    stream. ``counts``: source, rows.

    The order is (hash, all other columns); places come from sums over parts of the hash range and
    from sums within a part.
    """
    ids = [c for c in docs.columns if c != "source"]
    parts = (F.floor(F.col("rows") / rows_per_part) + 1).cast("long")
    spread = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 1)
    cut = (
        with_source(docs.withColumn("order", spread), counts.select("source", parts.alias("parts")))
        .withColumn("part", F.floor(F.col("order") / (F.lit(float(2**63)) / F.col("parts"))))
        .drop("parts")
    )
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.groupBy("source", "part").agg(F.sum("size").alias("words")).select(
        F.col("source").alias("_source"), F.col("part").alias("_part"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("source", "part").orderBy("order", *ids).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("local", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(bases, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
        .withColumn("start", F.col("base") + F.col("local"))
        .select(*docs.columns, "start")
    )


def block_plan(goals: DataFrame, block_words: int) -> DataFrame:
    """Goals with ``block_words`` (the words of a block of the source), ``blocks`` (blocks in one pass over
    the source), ``slots`` (blocks to take) and ``low``, the first of its points among all slots."""
    words = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("target") / LEAST_SLOTS))).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    before = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        goals.withColumn("block_words", words)
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
        .withColumn("passes", passes)
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.round(rest / F.col("block_words")).cast("long"))
        .withColumn("low", F.coalesce(F.sum("slots").over(before), F.lit(0)))
        .drop("passes")
    )


def schedule(plan: DataFrame, bits: int) -> DataFrame:
    """slot, source, block, turn (which pass over the source) from a :func:`block_plan`.

    ``bits`` is m of the 2^m slots; slots whose point lies beyond the last weight are idle and left out.
    Spark takes exploded slots for as small as the plan that they come from, so the joins below and in
    :meth:`Mix.taken` are told to shuffle them.
    """
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("slots") - 1).cast("long"), F.lit(SLOTS_PER_PART).cast("long")))
    parts = plan.where("slots > 0").withColumn("from", chunk)
    parts = parts.repartition("source", "from")
    to = F.least(F.col("from") + SLOTS_PER_PART, F.col("slots")) - 1
    points = parts.withColumn("point", F.explode(F.sequence(F.col("low") + F.col("from"), F.col("low") + to)))
    if bits:
        reversed_bits = F.reverse(F.lpad(F.bin("point"), bits, "0"))
        points = points.withColumn("slot", F.conv(reversed_bits, 2, 10).cast("long"))
    else:
        points = points.withColumn("slot", F.lit(0).cast("long"))
    points = points.select("slot", "source", "blocks").withColumn("part", F.floor(F.col("slot") / SLOTS_PER_PART))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = points.groupBy("source", "part").agg(F.count("*").alias("n")).select(
        F.col("source").alias("_source"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("source", "part").orderBy("slot")
    rank = F.col("base") + F.row_number().over(within) - 1
    return (
        points.join(bases.hint("merge"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
        .withColumn("rank", rank)
        .select("slot", "source", F.pmod("rank", F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("turn"))
    )


class Mix:
    """The schedule of a mix and the documents that stand in its blocks.

    ``goals``: source, source_size, target. ``schedule``: slot, source, block, turn. ``members``: the
    documents' pieces, one row per document and block that it meets (source, block, piece words).
    ``docs``: every input row with size and start.
    """

    def __init__(
        self,
        docs: DataFrame,
        weights: tuple[float, ...] = (5, 2, 1),
        most: float = 3.0,
        block_words: int = 256,
        seed: int = 0,
    ):
        spark = docs.sparkSession
        path = scratch_path(spark, "mix")
        sized = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), _tie(docs).alias("tie"))
        sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
        block_plan(targets(sizes, weights, most), block_words).write.parquet(f"{path}/plan")
        plan = spark.read.parquet(f"{path}/plan")
        self.goals = plan.select("source", "source_size", "target")
        slots = plan.agg(F.sum("slots")).first()[0] or 0
        self.schedule = schedule(plan, max(0, (slots - 1).bit_length()))
        stream(sized, plan.select("source", "rows"), seed).write.parquet(f"{path}/docs")
        self.docs = spark.read.parquet(f"{path}/docs")
        self.block_words = plan.select("source", "block_words")
        of_source = F.col("block_words")
        first = F.floor(F.col("start") / of_source)
        last = F.floor((F.col("start") + F.col("size") - 1) / of_source)
        block = F.explode(F.sequence(first, last))
        begin = F.greatest(F.col("start"), F.col("block") * of_source)
        end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * of_source)
        self.members = with_source(self.docs.where("size > 0"), self.block_words).withColumn("block", block).withColumn("words", end - begin)

    def _used(self, rows: DataFrame) -> DataFrame:
        """Rows (source, block) with ``uses``, how often the schedule takes the block; null for never."""
        uses = self.schedule.groupBy("source", "block").agg(F.count("*").alias("uses")).withColumnsRenamed(
            {"source": "_source", "block": "_block"}
        )
        met = F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
        return rows.join(uses.hint("merge"), met, "left").drop("_source", "_block")

    def documents(self, docs: DataFrame) -> DataFrame:
        """The mix as whole documents: each is repeated as often as the block of its first word is taken.

        ``docs`` is the table that the mix was made from; all its columns stay. Texts are shuffled once,
        by (doc_id, hash of the row); rows that agree in all columns share their repeats.
        """
        copies = (
            self._used(with_source(self.docs, self.block_words).withColumn("block", F.floor(F.col("start") / F.col("block_words"))))
            .where("uses > 0")
            .groupBy("doc_id", "tie")
            .agg(F.sum("uses").alias("uses"))
            .withColumnsRenamed({"doc_id": "_doc_id", "tie": "_tie"})
        )
        whole = docs.select("doc_id", _tie(docs).alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
        rows = whole.groupBy("doc_id", "_row").agg(F.first("_doc").alias("_doc"))
        met = rows.join(copies, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_row") == F.col("_tie")))
        turns = F.explode(F.sequence(F.lit(1).cast("long"), F.col("uses")))
        return met.select("_doc", turns.alias("_turn")).select("_doc.*")

    def taken(self) -> DataFrame:
        """Every document with size, source_size, target and ``taken``, the words that the mix takes of it."""
        keys = [c for c in self.docs.columns if c not in ("source", "size")]
        # A document with words is alone at its start.
        by_doc = (
            self._used(self.members)
            .groupBy(*keys, "source", "size")
            .agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).alias("taken"))
            .unionByName(self.docs.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
        )
        return with_source(by_doc, self.goals)
