"""Near-equal names, and company names split into legal form and bare name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.filters import union_all_sources
from tablewright.session import cut_lineage

HOT_BLOCK = 1_000
_MAX_ROUNDS = 6


def _segment(rest_len: str, i: int, segments: int) -> tuple[str, str]:
    """Start (from 0) and length of the i-th of near-equal segments, as SQL."""
    start = f"({rest_len} * {i} div {segments})"
    return start, f"({rest_len} * {i + 1} div {segments} - {start})"


def _cut(i: int, start: str, length: str) -> str:
    """The block of the segment at ``start``, and the text without it."""
    return (
        f"named_struct('block', concat(block, '|{i}|', substr(rest, {start} + 1, {length})), "
        f"'rest', concat(substr(rest, 1, {start}), substr(rest, {start} + {length} + 1)))"
    )


def _index_blocks(rows: DataFrame, segments: int) -> DataFrame:
    """(block, name, rest): one block per segment of what is left of the name."""
    cuts = [_cut(i, *_segment("length(rest)", i, segments)) for i in range(segments)]
    return rows.selectExpr("name", f"inline(array({', '.join(cuts)}))")


def _probe_blocks(rows: DataFrame, distance: int) -> DataFrame:
    """(block, name, rest, shorter): every place where a segment of a name ``shorter`` by that much may sit.

    A segment moved by m leaves at least ``|m|`` edits before it and ``|shorter - m|`` behind it.
    """
    segments, places = distance + 1, []
    for i in range(segments):
        start, length = _segment("(length(rest) - shorter)", i, segments)
        for move in range(-distance, distance + 1):
            at = f"({start} + {move})"
            fits = (
                f"length(rest) - shorter >= {segments} AND {at} >= 0 AND {at} + {length} <= length(rest) "
                f"AND {abs(move)} + abs(shorter - {move}) <= {distance}"
            )
            if any(abs(move) + abs(s - move) <= distance for s in range(distance + 1)):
                places.append(f"CASE WHEN {fits} THEN {_cut(i, at, length)} END")
    return rows.selectExpr("name", "shorter", f"inline(filter(array({', '.join(places)}), p -> p IS NOT NULL))")


def _verified(index: DataFrame, probes: DataFrame, on: Sequence[str], distance: int) -> DataFrame:
    """Pairs of a block that are truly near. Names of equal length meet in one direction only."""
    left = index.select(*[F.col(c).alias(f"_i_{c}") for c in on], F.col("name").alias("a"))
    right = probes.select(*on, F.col("name").alias("b"))
    near = F.levenshtein(F.col("a"), F.col("b"), distance)
    same_block = F.lit(True)
    for c in on:
        same_block = same_block & (F.col(f"_i_{c}") == F.col(c))
    ordered = (F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    return left.join(right, same_block & ordered & (near >= 0), "inner").select("a", "b")


def _in_cells(index: DataFrame, probes: DataFrame, distance: int, most: int) -> DataFrame:
    """Pairs of all blocks, with no more than about ``most`` names from either side in one group.

    A block of more names is dealt out by hash, on both sides; each part of one meets each of the other.
    """

    def parts(rows: DataFrame, name: str) -> DataFrame:
        sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
        return sizes.select("block", F.ceil(F.col("_n") / most).cast("int").alias(name))

    crowded = cut_lineage(parts(index, "_index_parts").join(parts(probes, "_probe_parts"), "block", "full"))
    if crowded.isEmpty():
        return _verified(index, probes, ["block"], distance)

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        count = {c: F.coalesce(F.col(f"_{c}_parts"), F.lit(1)) for c in (own, other)}
        mine = F.pmod(F.xxhash64("name"), count[own]).cast("int").alias(own)
        return rows.join(crowded, "block", "left").select("block", "name", mine, F.explode(F.sequence(F.lit(0), count[other] - 1)).alias(other))

    return _verified(dealt(index, "index", "probe"), dealt(probes, "probe", "index"), ["block", "index", "probe"], distance)


def _short_pairs(names: DataFrame, distance: int, most: int) -> DataFrame:
    """Pairs whose shorter name is too short for segments, by length; the longer side is dealt out by hash."""
    salts = max(1, -(-names.where(F.length("name") <= 2 * distance).count() // most))
    short = names.where(F.length("name") <= distance).select(
        "name",
        F.explode(F.sequence(F.length("name"), F.length("name") + distance)).alias("long_len"),
        F.length("name").alias("short_len"),
    )
    short = short.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    longer = names.where(F.length("name") <= 2 * distance).select(
        "name",
        F.length("name").alias("long_len"),
        F.explode(F.sequence(F.lit(0), F.lit(distance))).alias("short_len"),
        F.pmod(F.xxhash64("name"), F.lit(salts)).cast("int").alias("salt"),
    )
    return _verified(short, longer, ["short_len", "long_len", "salt"], distance)


def fuzzy_pairs(
    df: DataFrame, id_col: str, name: str, max_distance: int = 3, prefix: int = 255, hot_block: int = HOT_BLOCK
) -> DataFrame:
    """Pairs of names within an edit distance, each in both directions, compared on a prefix.

    Works on distinct names: ``rows_1`` and ``rows_2`` count the rows behind each, and a name held
    by several rows pairs with itself at distance 0, which stands for all pairs of those rows.

    Nothing is compared with everything. A name cut in ``max_distance + 1`` segments keeps one of
    them unchanged under ``max_distance`` edits, moved by as many places at most; equal segments
    are equi-join keys. Where more than ``hot_block`` names share a segment, what is left of the
    names is cut again in the same way, so a common word narrows the search and no pair is lost. What
    cannot be narrowed, or is not after ``_MAX_ROUNDS`` rounds, is compared in cells of that many names.
    """
    distance = max_distance
    counted = cut_lineage(
        df.where(F.col(name).isNotNull())
        .groupBy(F.substring(name, 1, prefix).alias("name"))
        .agg(F.count(id_col).alias("rows"))
    )
    names = counted.select("name")
    index = names.where(F.length("name") > distance).select(
        "name", F.length("name").cast("string").alias("block"), F.col("name").alias("rest")
    )
    probes = names.select(
        "name",
        F.explode(F.sequence(F.lit(0), F.lit(distance))).alias("shorter"),
        F.col("name").alias("rest"),
    ).select("name", "shorter", (F.length("name") - F.col("shorter")).cast("string").alias("block"), "rest")
    found = [_short_pairs(names, distance, hot_block)]
    for round_no in range(_MAX_ROUNDS):
        blocks, places = _index_blocks(index, distance + 1), _probe_blocks(probes, distance)
        hot = None
        if round_no < _MAX_ROUNDS - 1:
            # A block can be narrowed while enough of its names is left to cut again.
            hot = cut_lineage(
                blocks.groupBy("block")
                .agg(F.count(F.lit(1)).alias("size"), F.min(F.length("rest")).alias("left"))
                .where((F.col("size") > hot_block) & (F.col("left") > distance))
                .select("block")
            )
            hot = None if hot.isEmpty() else hot
        cold = blocks if hot is None else blocks.join(hot, "block", "left_anti")
        found.append(_in_cells(cold, places if hot is None else places.join(hot, "block", "left_anti"), distance, hot_block))
        if hot is None:
            break
        index = cut_lineage(blocks.join(hot, "block", "left_semi"))
        probes = cut_lineage(places.join(hot, "block", "left_semi"))
    pairs = union_all_sources(*found).distinct()
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = counted.select(F.col("name").alias("a"), F.col("rows").alias("rows_1"))
    second = counted.select(F.col("name").alias("b"), F.col("rows").alias("rows_2"))
    near = both.join(first, "a").join(second, "b")
    out = near.select(
        F.col("a").alias("name_1"),
        F.col("b").alias("name_2"),
        F.levenshtein("a", "b").alias("distance"),
        "rows_1",
        "rows_2",
    )
    same = counted.where(F.col("rows") > 1).select(
        F.col("name").alias("name_1"),
        F.col("name").alias("name_2"),
        F.lit(0).alias("distance"),
        F.col("rows").alias("rows_1"),
        F.col("rows").alias("rows_2"),
    )
    return out.union(same)


def name_normalize_legal_form(
    df: DataFrame,
    name: str,
    forms: Sequence[str],
    mapping: tuple[str, str] = ("", ""),
    skip: Sequence[str] = (),
    only_without_form: bool = True,
) -> DataFrame:
    """Split names into legal form and bare name after mapping letters; report those without a form.

    ``forms`` are regular expressions tried in order at the start of the name, in any letter case.
    Quotes and space around the bare name are cut. ``skip`` are patterns of names known to have
    none. ``total_count`` counts the reported names.
    """
    normalized = F.translate(F.col(name), *mapping) if mapping[0] else F.col(name)
    pattern = r"(?iu)^\s*(" + "|".join(forms) + r")?[\s'\"“”«»’]*(.*?)[\s'\"“”«»’]*$"
    out = (
        df.withColumn("normalized_name", F.trim(normalized))
        .withColumn("firm_form", F.regexp_extract("normalized_name", pattern, 1))
        .withColumn("firm_form", F.when(F.col("firm_form") != "", F.col("firm_form")))
        .withColumn("firm_name", F.regexp_extract("normalized_name", pattern, 2))
    )
    if only_without_form:
        out = out.where(F.col("firm_form").isNull())
    for p in skip:
        out = out.where(~F.col("normalized_name").ilike(p))
    return out.crossJoin(F.broadcast(out.agg(F.count(F.lit(1)).alias("total_count"))))
