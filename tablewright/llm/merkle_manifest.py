"""Merkle manifest of a table: one tree of digests per value of a column, and one over their roots.

A node carries the interval of leaf ranks that it covers (``lo`` to ``hi``, the latter excluded). Ranks
come from a range-partitioned sort, so neither a tree with most of the rows nor many copies of one row
is ordered in one task. Each level groups at most ``fan`` consecutive nodes and is written to the shared
folder. Proofs are made from the top down: a node's parent is the node one level up whose interval holds
its own, found by an equi-join on (tree, bucket of the level's width) and confirmed by containment, and
its siblings are the parent's children whose intervals lie before or after its own. What a node needs of
the levels above goes down with it, so a leaf is joined with its parent only.

Defined results: a null field is `-` in its leaf; the null tree comes first; rows of equal order are
ordered by their leaf digest, equal rows take consecutive ranks in any order (as a set, the result is the
same); a null order value comes first; an empty table gives no rows. Columns that are no fields are not
looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.graph import stored

_PLACES = 33  # bits that monotonically_increasing_id leaves for the row within its partition


def field_text(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hex_text(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def _name(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def positions(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with ``position``, the place from 0 in the order of ``by``, nulls first.

    Rows are dealt by ranges of (by, place in the input), so that copies are spread as well. Sums over
    partitions give the first position of each; their number is that of the shuffle partitions.
    """
    placed = stored(
        rows.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(*by, "tie")
        .sortWithinPartitions(*by, "tie")
        .withColumn("place", F.monotonically_increasing_id()),
        "placed",
    )
    part, local = F.shiftright("place", _PLACES), F.col("place").bitwiseAND(F.lit((1 << _PLACES) - 1))
    counts = placed.groupBy(part.alias("part")).agg((F.max(local) + 1).alias("rows"))
    earlier = F.transform(
        F.filter("all", lambda x: x["part"] < F.col("one.part")), lambda x: x["rows"]
    )
    first = (
        counts.agg(F.collect_list(F.struct("part", "rows")).alias("all"))
        .withColumn("one", F.explode("all"))
        .select(F.col("one.part").alias("part"), F.aggregate(earlier, F.lit(0).cast("long"), lambda a, x: a + x).alias("base"))
    )
    return (
        placed.withColumn("part", part)
        .join(F.broadcast(first), "part")
        .withColumn("position", F.col("base") + local)
        .drop("tie", "place", "part", "base")
    )


def grow(nodes: DataFrame, fan: int) -> list[DataFrame]:
    """The levels above ``nodes`` (tree, n leaves of the tree, lo, hi, digest and what a leaf holds).

    A level has tree, n, bucket, lo, hi, digest and kids; trees of n leaves end at the first level whose
    nodes cover n ranks.
    """
    levels: list[DataFrame] = []
    most, width = nodes.agg(F.max("n")).first()[0] or 0, 1
    while width < most:
        inside = [c for c in nodes.columns if c not in ("tree", "n", "bucket", "kids")]
        groups = (
            nodes.where(F.col("n") > width)
            .groupBy("tree", "n", F.expr(f"lo div {width * fan}").alias("bucket"))
            .agg(F.sort_array(F.collect_list(F.struct(*inside))).alias("kids"))
        )
        joined = F.array_join(F.transform("kids", lambda k: hex_text(k["digest"])), "")
        nodes = stored(
            groups.select(
                "tree", "n", "bucket", F.get("kids", F.lit(0))["lo"].alias("lo"), F.array_max("kids.hi").alias("hi"),
                digest(joined).alias("digest"), "kids",
            ),
            "level",
        )
        levels.append(nodes)
        nodes, width = nodes.drop("bucket", "kids"), width * fan
    return levels


def roots(nodes: DataFrame, levels: Sequence[DataFrame], fan: int) -> DataFrame:
    """tree, n and digest of each tree's last node."""
    out = nodes.where("n = 1").select("tree", "n", "digest")
    for i, level in enumerate(levels, 1):
        out = out.unionByName(level.where(F.col("n") <= fan**i).select("tree", "n", "digest"))
    return out


def descend(nodes: DataFrame, levels: Sequence[DataFrame], tops: DataFrame, fan: int) -> DataFrame:
    """What ``nodes`` hold, with ``path``, the siblings (left, right) of every level up to the root.

    ``tops``: tree, n, path and more for the last node of each tree; all its columns go down.
    """
    extra = [c for c in tops.columns if c not in ("tree", "n", "path")]
    held = [c for c in nodes.columns if c not in ("tree", "n", "lo", "hi")]
    down = None
    for i in reversed(range(len(levels))):
        level, width = levels[i], fan ** (i + 1)
        ends = tops.where((F.col("n") <= width) & (F.col("n") > fan**i))
        ends = ends.select("tree", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"), "path", *extra)
        down = ends if down is None else down.unionByName(ends)
        inner = down.select(
            F.col("tree").alias("down_tree"), F.expr(f"lo div {width}").alias("down_bucket"),
            F.col("lo").alias("down_lo"), F.col("hi").alias("down_hi"), "path", *extra,
        )
        same = (F.col("tree") == F.col("down_tree")) & (F.col("bucket") == F.col("down_bucket"))
        within = (F.col("lo") <= F.col("down_lo")) & (F.col("down_hi") <= F.col("hi"))
        kids = level.join(inner, same & within).select("tree", "kids", F.explode("kids").alias("kid"), "path", *extra)

        def beside(which):
            nothing = F.lit("").cast("binary")
            return F.aggregate(F.filter("kids", which), nothing, lambda a, k: F.concat(a, k["digest"]))

        left = beside(lambda k: k["hi"] <= F.col("kid.lo"))
        right = beside(lambda k: k["lo"] >= F.col("kid.hi"))
        path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("path"))
        own = ["lo", "hi"] if i else held
        down = kids.select("tree", *[F.col(f"kid.{c}").alias(c) for c in own], path.alias("path"), *extra)
    single = nodes.where("n = 1").select("tree", *held).join(tops.where("n = 1").drop("n"), "tree")
    single = single.select("tree", *held, "path", *extra)
    return single if down is None else single.unionByName(down)


def merkle_manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    tree: str = "lang",
    order: str = "doc_id",
    fan: int = 8,
    found: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Per row: ``order``'s column, ``leaf``, ``subroot`` (its tree's), ``root``, ``proof`` (siblings up to
    the root as an array of left and right digests, 32 bytes each) and ``found_leaf``.

    ``found`` gives expressions over ``docs`` that replace fields in ``found_leaf``, the digest of a copy
    to be verified; without it, it is the leaf.
    """
    found = found or {}
    leaf = digest(F.concat(*[field_text(_name(c)) for c in fields]))
    other = digest(F.concat(*[field_text(found.get(c, _name(c))) for c in fields])) if found else leaf
    rows = stored(
        docs.select(_name(tree).cast("string").alias("key"), _name(order).alias("id"), leaf.alias("digest"), other.alias("found")),
        "leaves",
    )
    ranked = positions(rows, ["key", "id", "digest"])
    # The position of its first leaf stands for a tree from here on: it has the order of the keys.
    trees = stored(ranked.groupBy("key").agg(F.min("position").alias("tree"), F.count("*").alias("n")), "trees")
    sized = ranked.join(trees.withColumnRenamed("key", "tree_key"), F.col("key").eqNullSafe(F.col("tree_key")))
    lo = F.col("position") - F.col("tree")
    nodes = stored(sized.select("tree", "n", lo.alias("lo"), (lo + 1).alias("hi"), "digest", "id", "found"), "nodes")
    levels = grow(nodes, fan)

    subroots = roots(nodes, levels, fan).select("tree", "n", "digest")
    among = positions(subroots.select("tree", F.col("n").alias("leaves"), "digest"), ["tree"])
    lone, n_trees = F.lit(0).cast("long"), F.lit(trees.count()).cast("long")
    forest = stored(
        among.select(
            lone.alias("tree"), n_trees.alias("n"), F.col("position").alias("lo"), (F.col("position") + 1).alias("hi"), "digest",
            F.col("tree").alias("of"), "leaves",
        ),
        "forest",
    )
    above = grow(forest, fan)
    no_path = F.array().cast("array<struct<left:binary,right:binary>>")
    top = roots(forest, above, fan).select("tree", "n", F.col("digest").alias("root"), no_path.alias("path"))
    tops = stored(
        descend(forest, above, top, fan).select(
            F.col("of").alias("tree"), F.col("leaves").alias("n"), F.col("digest").alias("subroot"), "root", "path"
        ),
        "tops",
    )
    return descend(nodes, levels, tops, fan).select(
        F.col("id").alias(order), F.col("digest").alias("leaf"), "subroot", "root",
        F.col("path").alias("proof"), F.col("found").alias("found_leaf"),
    )


def proof_text(proof: Column) -> Column:
    """All sibling digests as hexadecimal text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(hex_text(s["left"]), hex_text(s["right"]))), "")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its siblings, as hexadecimal text."""
    return F.aggregate(
        proof, hex_text(leaf), lambda a, s: F.sha2(F.concat(hex_text(s["left"]), a, hex_text(s["right"])), 256)
    )
