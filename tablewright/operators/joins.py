"""Joins. Sizes decide the strategy at run time; only one-row tables and driver lists are broadcast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.ordered import as_list

REPEATS = 10_000  # rows that one array brings back at most


def star_join_paged(
    fact: DataFrame,
    dims: Sequence[tuple[DataFrame, Column | str | list[str]]],
    order: Sequence[Column | str],
    limit: int,
    offset: int = 0,
    select: Sequence[Column | str] | None = None,
) -> DataFrame:
    """Inner equi-joins of a fact with its dimensions, one page of the sorted result.

    Every task keeps ``offset + limit`` rows: for pages far from the start hand :func:`star_join` to
    :func:`tablewright.operators.paging.deep_page`.
    """
    return star_join(fact, dims, select).orderBy(*order).offset(offset).limit(limit)


def star_join(
    fact: DataFrame, dims: Sequence[tuple[DataFrame, Column | str | list[str]]], select: Sequence[Column | str] | None = None
) -> DataFrame:
    out = fact
    for dim, on in dims:
        out = out.join(dim, on, "inner")
    return out.select(*select) if select else out


def left_join_chain(base: DataFrame, steps: Sequence[tuple[DataFrame, Sequence[tuple[str, str]]]]) -> DataFrame:
    """Left joins one after the other; each step names its (left, right) key pairs."""
    out = base
    for right, pairs in steps:
        on = F.lit(True)
        for left_key, right_key in pairs:
            on = on & (out[left_key] == right[right_key])
        out = out.join(right, on, "left")
    return out


def distinct_join_filter(
    left: DataFrame,
    right: DataFrame,
    on: Column,
    where: Column,
    cols: Sequence[str],
    order: Sequence[Column | str],
    limit: int | None = None,
) -> DataFrame:
    out = left.join(right, on, "inner").where(where).select(*cols).distinct().orderBy(*order)
    return out if limit is None else out.limit(limit)


def correlated_counts(outer: DataFrame, detail: DataFrame, key: tuple[str, str], counts: Mapping[str, Column]) -> DataFrame:
    """Several conditional counts per outer row from one pass over the detail; 0 when it has none."""
    outer_key, detail_key = key
    per_key = detail.groupBy(F.col(detail_key).alias("_key")).agg(
        *[F.count_if(p).alias(n) for n, p in counts.items()]
    )
    joined = outer.join(per_key, outer[outer_key] == per_key["_key"], "left")
    return joined.drop("_key").fillna(0, subset=list(counts))


def correlated_top1(outer: DataFrame, detail: DataFrame, key: tuple[str, str], expr: Column, name: str) -> DataFrame:
    """The smallest value of an expression per outer row; NULL when the detail has no row."""
    return lateral_table_per_row(outer, detail, key, [F.min(expr).alias(name)])


def lateral_table_per_row(
    outer: DataFrame, detail: DataFrame, key: tuple[str, str], aggs: Sequence[Column], keep_unmatched: bool = True
) -> DataFrame:
    """A grouped subquery per outer row: ``OUTER APPLY``, or ``CROSS APPLY`` without unmatched rows."""
    outer_key, detail_key = key
    per_key = detail.groupBy(F.col(detail_key).alias("_key")).agg(*aggs)
    how = "left" if keep_unmatched else "inner"
    return outer.join(per_key, outer[outer_key] == per_key["_key"], how).drop("_key")


def full_outer_by_key(a: DataFrame, b: DataFrame, key: tuple[str, str]) -> DataFrame:
    """``FULL OUTER JOIN`` on one key pair; column names of both sides must differ.

    Written as an inner join and two anti joins: a skewed full join cannot be split at run time,
    these can, on either side.
    """
    a_key, b_key = key
    both = a.join(b, a[a_key] == b[b_key], "inner")
    only_a = a.join(b.select(F.col(b_key).alias("_key")).distinct(), a[a_key] == F.col("_key"), "left_anti")
    only_b = b.join(a.select(F.col(a_key).alias("_key")).distinct(), b[b_key] == F.col("_key"), "left_anti")
    return both.unionByName(only_a, allowMissingColumns=True).unionByName(only_b, allowMissingColumns=True)


def one_sided_keys(a: DataFrame, b: DataFrame, key: tuple[str, str], tags: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Keys of rows that the other side lacks, tagged with their side. NULL keys never match.

    Both sides are counted per key in one grouping: each is read once, and a task holds distinct keys
    instead of sorted rows. A key that one side lacks comes out as often as the other has it.
    """
    ones = a.select(F.col(key[0]).alias("key"), F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    twos = b.select(F.col(key[1]).alias("key"), F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    counts = ones.union(twos).groupBy("key").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))

    def lone(own: str, other: str, tag: str) -> Column:
        alone = (F.col(own) > 0) & (F.col("key").isNull() | (F.col(other) == 0))
        return F.when(alone, F.struct(F.lit(tag).alias("side"), F.col(own).alias("_n")))

    sides = F.filter(F.array(lone("_a", "_b", tags[0]), lone("_b", "_a", tags[1])), lambda s: s.isNotNull())
    found = counts.select("key", F.inline(sides))
    # In pieces, so that no row holds an array of unknown size.
    pieces = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / REPEATS))
    found = found.withColumn("_piece", F.explode(pieces))
    times = F.least(F.lit(REPEATS), F.col("_n") - F.col("_piece") * REPEATS).cast("int")
    return found.withColumn("_again", F.explode(F.array_repeat(F.lit(0), times))).select("key", "side")


def anti_join_candidates(
    df: DataFrame, where: Column, others: Sequence[tuple[DataFrame, tuple[str, str]]]
) -> DataFrame:
    """Rows meeting the filter and linked in none of the other tables."""
    out = df.where(where)
    for other, (own_key, other_key) in others:
        linked = other.select(F.col(other_key).alias("_key")).distinct()
        out = out.join(linked, out[own_key] == linked["_key"], "left_anti")
    return out


def not_in_subquery(df: DataFrame, col: str, other: DataFrame, other_col: str) -> DataFrame:
    """``NOT IN (SELECT ...)`` by SQL rules, without the nested loop of a null-aware join.

    A NULL in the subquery leaves no row; a NULL on the left passes only an empty subquery.
    """
    known = other.select(F.col(other_col).alias("_key")).where("_key IS NOT NULL").distinct()
    facts = other.agg(
        F.coalesce(F.bool_or(F.col(other_col).isNull()), F.lit(False)).alias("_has_null"),
        (F.count(F.lit(1)) == 0).alias("_empty"),
    )
    return (
        df.join(known, df[col] == known["_key"], "left_anti")
        .crossJoin(F.broadcast(facts))
        .where("NOT _has_null")
        .where(F.col(col).isNotNull() | F.col("_empty"))
        .drop("_has_null", "_empty")
    )


def or_condition_join(a: DataFrame, a_col: str, b: DataFrame, b_cols: tuple[str, str]) -> DataFrame:
    """Join where either of two keys matches, a pair meeting both appearing once.

    An OR over join keys would run as a nested loop; two equi-joins do not.
    """
    first, second = b_cols
    by_first = a.join(b, a[a_col] == b[first], "inner")
    by_second = a.join(b, (a[a_col] == b[second]) & ~b[first].eqNullSafe(b[second]), "inner")
    return by_first.union(by_second)


def lookup_exact_or_prefix_join(
    df: DataFrame,
    lookup: DataFrame,
    level: tuple[str, str],
    name: str,
    key: str,
    values: Sequence[str],
    sep: str = ".",
) -> DataFrame:
    """Left lookup on equal level and (name, or its part before ``sep``, equal to the key).

    Every branch is an equi-join on (level, key): the level alone has few values and would gather
    most rows in a few tasks.
    """
    own_level, lookup_level = level
    types = lookup.select(
        F.col(lookup_level).alias("_level"), F.col(key).alias("_lookup_key"), *[F.col(v) for v in values]
    )
    short = F.split_part(F.col(name), F.lit(sep), F.lit(1))
    rows = df.withColumn("_short", short)
    same_level = rows[own_level] == types["_level"]
    exact = same_level & (rows[name] == types["_lookup_key"])
    prefix = same_level & (rows["_short"] == types["_lookup_key"])
    found = rows.join(types, exact, "inner").union(
        rows.join(types, prefix & ~rows["_short"].eqNullSafe(rows[name]), "inner")
    )
    keys = types.select("_level", "_lookup_key").distinct()
    lost = rows
    for column in (name, "_short"):
        lost = lost.join(keys, (lost[own_level] == keys["_level"]) & (lost[column] == keys["_lookup_key"]), "left_anti")
    out = found.drop("_level", "_lookup_key").unionByName(lost, allowMissingColumns=True)
    return out.drop("_short")


def self_join_pairs(df: DataFrame, left_key: str, right_key: str, id_col: str, cols: Sequence[str] = ()) -> DataFrame:
    """Pairs whose left key equals the right key, a row never with itself.

    One of the two keys should identify a row (a parent link); two repeated keys multiply.
    """
    old = df.select(F.col(left_key).alias("_l"), *[F.col(c).alias(f"old_{c}") for c in (id_col, *cols)])
    new = df.select(F.col(right_key).alias("_r"), *[F.col(c).alias(f"new_{c}") for c in (id_col, *cols)])
    condition = (old["_l"] == new["_r"]) & (old[f"old_{id_col}"] != new[f"new_{id_col}"])
    return old.join(new, condition, "inner").drop("_l", "_r")


def nonequi_self_join_count(df: DataFrame, id_col: str, where: Column | None = None) -> DataFrame:
    """Number of ordered pairs with different ids, from group sizes instead of the pairs.

    All pairs of n rows are n * n; those with equal ids are the squares of the group sizes.
    """
    rows = df if where is None else df.where(where)
    sizes = rows.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).cast("decimal(19,0)").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("decimal(19,0)")
    same = F.coalesce(F.sum((F.col("n") * F.col("n")).cast("decimal(38,0)")), F.lit(0))
    return sizes.agg((total * total - same).cast("decimal(38,0)").alias("pairs"))


def ordered_lookup_report(names: Sequence[str], df: DataFrame, name_col: str) -> DataFrame:
    """A hand-ordered list, headings included, with the values of the names that have any.

    The list is broadcast to the table; names without a value are added, so a name with many rows
    is never gathered by its place in the list.
    """
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, n) for i, n in enumerate(names, start=1)], "ordinal int, name string")
    values = [c for c in df.columns if c != name_col]
    rows = df.select(F.col(name_col).alias("_name"), *values)
    hits = rows.join(F.broadcast(wanted), rows["_name"] == wanted["name"], "inner").select("ordinal", "name", *values)
    known = hits.select(F.col("ordinal").alias("_known")).distinct()
    empty = wanted.join(known, wanted["ordinal"] == known["_known"], "left_anti")
    return hits.unionByName(empty, allowMissingColumns=True).orderBy("ordinal", *values)


def audit_join_lookup(
    audit: DataFrame,
    alias: DataFrame,
    base: DataFrame,
    lookup: DataFrame,
    url_prefix: str,
    *,
    map_col: str = "row_data",
    kind: str = "relid",
    alias_key: str = "relid",
    alias_name: str = "tablename",
    base_key: str = "id",
    base_link: str = "type_id",
    lookup_key: str = "type_id",
    target_kind: str,
    image_key: str = "id",
) -> DataFrame:
    """Audit rows of one kind, by alias or own name, joined over their image key to base and type; adds a URL."""
    names = alias.select(F.col(alias_key).alias("_alias_key"), F.col(alias_name).alias("_alias_name"))
    named = (
        audit.join(names, audit[kind] == names["_alias_key"], "left")
        .withColumn("table_name", F.coalesce("_alias_name", kind))
        .where(F.col("table_name") == target_kind)
        .withColumn("base_id", F.try_element_at(F.col(map_col), F.lit(image_key)))
        .drop("_alias_key", "_alias_name")
    )
    keyed = base.withColumn("_base_key", F.col(base_key).cast("string"))
    joined = named.join(keyed, named["base_id"] == keyed["_base_key"], "inner").drop("_base_key")
    types = lookup.withColumnRenamed(lookup_key, "_type_key")
    out = joined.join(types, joined[base_link] == types["_type_key"], "inner").drop("_type_key")
    return out.withColumn("url", F.concat(F.lit(url_prefix), F.col("base_id")))
