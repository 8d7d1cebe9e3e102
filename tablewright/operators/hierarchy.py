"""Reachability and roll-ups over edge lists and parent pointers.

Each round joins only what the last one found, and is checkpointed: rounds do not pile up in one
plan, and a lost executor repeats one round.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.filters import union_all_sources
from tablewright.operators.joins import lookup_exact_or_prefix_join, or_condition_join
from tablewright.session import cut_lineage

# Fixed value: what stands between the names of a path.
ARROW = " ➫ "
ROUNDS_BEFORE_CYCLE_TEST = 64


def membership_closure(
    edges: DataFrame, member: str, role: str, nodes: DataFrame | None = None
) -> DataFrame:
    """All (member, role, path) reachable over an edge list.

    ``nodes`` (one column) adds those that are never a member, with a NULL role and an empty path.
    A role already on the path is not entered again, which ends the search on cycles too. The links are
    joined by merging in every round: a broadcast would bring them, or the round, to the driver each time.
    """
    links = cut_lineage(edges.select(F.col(member).alias("_m"), F.col(role).alias("_r")).distinct())
    found = [
        cut_lineage(
            links.select(
                F.col("_m").alias("member"),
                F.col("_r").alias("role"),
                F.concat_ws(ARROW, F.col("_m").cast("string"), F.col("_r").cast("string")).alias("path"),
                F.array("_m", "_r").alias("_seen"),
            )
        )
    ]
    while True:
        last = found[-1]
        step = last.join(links.hint("merge"), last["role"] == links["_m"], "inner").where(~F.array_contains("_seen", F.col("_r")))
        step = cut_lineage(
            step.select(
                "member",
                F.col("_r").alias("role"),
                F.concat_ws(ARROW, "path", F.col("_r").cast("string")).alias("path"),
                F.array_append("_seen", F.col("_r")).alias("_seen"),
            )
        )
        if step.isEmpty():
            break
        found.append(step)
    out = union_all_sources(*found).drop("_seen")
    if nodes is None:
        return out
    name = nodes.columns[0]
    members = links.select("_m").distinct()
    lone = nodes.distinct().join(members.hint("merge"), nodes[name] == members["_m"], "left_anti")
    kind = out.schema["role"].dataType
    return out.union(lone.select(F.col(name).alias("member"), F.lit(None).cast(kind).alias("role"), F.lit("").alias("path")))


def reachable_pairs(edges: DataFrame, member: str, role: str, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct (member, role) of :func:`membership_closure`, without the paths between them.

    Where many paths join two nodes, paths grow exponentially and pairs do not. Every round joins the pairs
    that the last one found with all pairs, on both sides, so rounds grow with the logarithm of the longest
    way; cycles end by themselves, as they bring no new pair. A node is no role of its own.
    """
    links = edges.select(F.col(member).alias("member"), F.col(role).alias("role"))
    pairs = cut_lineage(links.where("member <> role").distinct())
    new = pairs
    while not new.isEmpty():
        def onward(first: DataFrame, second: DataFrame) -> DataFrame:
            steps = second.select(F.col("member").alias("_via"), F.col("role").alias("_to"))
            return first.join(steps, F.col("role") == F.col("_via")).select("member", F.col("_to").alias("role"))

        found = onward(new, pairs).union(onward(pairs, new)).where("member <> role").distinct()
        new = cut_lineage(found.join(pairs, ["member", "role"], "left_anti"))
        pairs = cut_lineage(pairs.union(new))
    if nodes is None:
        return pairs
    name = nodes.columns[0]
    members = links.where(F.col("member").isNotNull()).select("member").distinct()
    lone = nodes.distinct().join(members, nodes[name] == members["member"], "left_anti")
    return pairs.union(lone.select(F.col(name).alias("member"), F.lit(None).cast(pairs.schema["role"].dataType).alias("role")))


def effective_grants(
    edges: DataFrame,
    nodes: DataFrame | None,
    grants: DataFrame,
    member: str = "member",
    role: str = "role",
    grantee: str = "grantee",
    paths: bool = True,
) -> DataFrame:
    """Grants joined to every closure row in which the grantee is the member or the role.

    Without ``paths`` distinct grants meet distinct pairs, which also ends on graphs of very many paths.
    """
    if paths:
        closure = membership_closure(edges, member, role, nodes)
        return or_condition_join(grants, grantee, closure, ("member", "role"))
    return or_condition_join(grants.distinct(), grantee, reachable_pairs(edges, member, role, nodes), ("member", "role"))


def subtree_rollup(
    nodes: DataFrame, id_col: str, parent: str, measure: str, name: str = "subtree_sum"
) -> DataFrame:
    """For every node the sum of a measure over itself and all nodes below it.

    Sums climb one level per round and are added up on the way, so no (ancestor, descendant) pair
    is ever built and a round is never larger than the level it stands on. A cycle has no sum and is
    an error; it is looked for once the climb has taken many rounds.
    """
    links = cut_lineage(nodes.select(F.col(id_col).alias("_id"), F.col(parent).alias("_parent"), F.col(measure).alias("_v")))
    levels = [links.groupBy(F.col("_id").alias("_node")).agg(F.sum("_v").alias("_sum"))]
    ids = links.select(F.col("_id").alias("_node")).distinct()
    parents = cut_lineage(
        links.select("_id", "_parent").distinct().join(ids, F.col("_parent") == F.col("_node"), "left_semi")
    )
    while True:
        last = levels[-1]
        climbed = cut_lineage(
            last.join(parents, last["_node"] == parents["_id"], "inner")
            .groupBy(F.col("_parent").alias("_node"))
            .agg(F.sum("_sum").alias("_sum"))
        )
        if climbed.isEmpty():
            break
        levels.append(climbed)
        if len(levels) == ROUNDS_BEFORE_CYCLE_TEST and _has_cycle(parents):
            raise ValueError("the parents form a cycle")
    return union_all_sources(*levels).groupBy(F.col("_node").alias(id_col)).agg(F.sum("_sum").alias(name))


def _has_cycle(parents: DataFrame) -> bool:
    """Whether parent pointers (_id, _parent) form a cycle.

    Pointers are doubled: after log2(n) + 1 rounds each has left any tree of n nodes at its root.
    """
    jumps = cut_lineage(parents.groupBy("_id").agg(F.min("_parent").alias("_up")))
    for _ in range(2 + math.ceil(math.log2(jumps.count() + 1))):
        onward = jumps.select(F.col("_id").alias("_from"), F.col("_up").alias("_to"))
        jumps = cut_lineage(jumps.join(onward, F.col("_up") == F.col("_from"), "inner").select("_id", F.col("_to").alias("_up")))
        if jumps.isEmpty():
            return False
    return True


def ancestor_flatten(
    nodes: DataFrame,
    lookup: DataFrame,
    depth: int = 5,
    min_level: int = 7,
    *,
    id_col: str = "id",
    parent: str = "parent",
    level: str = "level",
    short: str = "short",
    carry: Sequence[str] = (),
    lookup_level: str = "level",
    lookup_key: str = "key",
    lookup_value: str = "type_name",
) -> DataFrame:
    """Rows at or below a level with ``depth`` ancestors as columns, each with its looked-up type name.

    Column names end in the distance: 0 for the row itself. The type is looked up once per node and
    travels with it; the same shuffled table serves every self-join.
    """
    typed = lookup_exact_or_prefix_join(
        nodes.select(id_col, parent, level, short, *carry), lookup, (level, lookup_level), short, lookup_key, [lookup_value]
    )
    kept = [id_col, level, *carry, lookup_value]
    out = typed.where(F.col(level) >= min_level).select(
        *[F.col(c).alias(f"{c}0") for c in kept], F.col(parent).alias("_up")
    )
    for n in range(1, depth + 1):
        above = typed.select(*[F.col(c).alias(f"{c}{n}") for c in kept], F.col(parent).alias("_next"))
        out = out.join(above, out["_up"] == above[f"{id_col}{n}"], "left").drop("_up").withColumnRenamed("_next", "_up")
    return out.drop("_up")
