"""Grouped summaries. Nothing gathers a whole group: members are cut to what the result shows first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.predicates import as_col
from tablewright.functions.text import format_interval
from tablewright.operators.ordered import as_list, numbered, running_total

GROUP_SALTS = 256
ROW_LIMIT = 1_000


def group_having_collect(
    df: DataFrame, keys: str | Sequence[str], member: str, max_count: int, sep: str | None = None
) -> DataFrame:
    """Groups of fewer than ``max_count`` rows, with their sorted members.

    A row number limit cuts every group to ``max_count`` rows before the shuffle, which is enough to
    tell that a group is too large. Spark applies it up to a limit of 1,000; above that the large
    groups are counted and left out first.
    """
    keys = as_list(keys)
    rows = df.select(*keys, member)
    if max_count <= ROW_LIMIT:
        in_group = Window.partitionBy(*keys).orderBy(F.col(member).asc_nulls_last())
        first = rows.withColumn("_n", F.row_number().over(in_group)).where(F.col("_n") <= max_count)
    else:
        large = df.groupBy(*[F.col(k).alias(f"_l_{k}") for k in keys]).count().where(F.col("count") >= max_count)
        same = F.lit(True)
        for k in keys:
            same = same & rows[k].eqNullSafe(large[f"_l_{k}"])
        first = rows.join(large, same, "left_anti")
    members = F.sort_array(F.collect_list(member))
    if sep is not None:
        members = F.array_join(members, sep)
    return (
        first.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("cnt"), members.alias("members"))
        .where(F.col("cnt") < max_count)
    )


def composite_key(keys: Sequence[str]) -> Column:
    """One fixed-size key for any number of columns of any length, NULL kept apart from empty."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in keys]
    sized = [F.concat(F.length(p).cast("string"), p) for p in parts]
    return F.sha2(F.concat(*sized), 256)


def duplicate_groups(
    df: DataFrame, keys: str | Sequence[str], member: str, size: str | None = None, show: int = 4
) -> DataFrame:
    """Groups of equal rows: count, total size and the first ``show`` members.

    The table is read once and only a digest of the key, the member and the size are shuffled. A
    group is summed up in salted parts, each keeping its first members, so that a group of any size
    is spread out; the parts of a group are then put together.
    """
    measure = F.col(size) if size else F.lit(1)
    salt = F.pmod(F.xxhash64(member), F.lit(GROUP_SALTS))
    rows = df.select(
        composite_key(as_list(keys)).alias("_key"), F.col(member).alias("_m"), measure.alias("_s"), salt.alias("_salt")
    )
    in_part = Window.partitionBy("_key", "_salt").orderBy("_m")
    parts = (
        rows.withColumn("_n", F.row_number().over(in_part))
        .groupBy("_key", "_salt")
        .agg(
            F.count(F.lit(1)).alias("_cnt"),
            F.sum("_s").alias("_size"),
            F.collect_list(F.when(F.col("_n") <= show, F.col("_m"))).alias("_first"),
        )
    )
    first = F.sort_array(F.flatten(F.collect_list("_first")))
    groups = parts.groupBy("_key").agg(
        F.sum("_cnt").alias("cnt"), F.sum("_size").alias("total_size"), first.alias("_members")
    )
    shown = [F.get("_members", F.lit(i)).alias(f"idx{i + 1}") for i in range(show)]
    return groups.where("cnt > 1").select("cnt", "total_size", *shown)


def conditional_sums(
    df: DataFrame, keys: str | Sequence[str], counts: Mapping[str, Column], flags: Mapping[str, Column] | None = None
) -> DataFrame:
    """Row count, one conditional count per name and one any-row flag per name."""
    return df.groupBy(*as_list(keys)).agg(
        F.count(F.lit(1)).alias("cnt"),
        *[F.count_if(p).alias(n) for n, p in counts.items()],
        *[F.coalesce(F.bool_or(p), F.lit(False)).alias(n) for n, p in (flags or {}).items()],
    )


def ratio_of_sums(df: DataFrame, a: Column | str, b: Column | str, keys: str | Sequence[str] = ()) -> DataFrame:
    """``sum(a) / (sum(a) + sum(b))``; NULL when both are 0."""
    return (
        df.groupBy(*as_list(keys))
        .agg(F.sum(as_col(a)).alias("sum_a"), F.sum(as_col(b)).alias("sum_b"))
        .withColumn("ratio", F.try_divide(F.col("sum_a").cast("double"), (F.col("sum_a") + F.col("sum_b")).cast("double")))
    )


def total_row_report(df: DataFrame, key: str, measures: Mapping[str, Column], label: str = "TOTAL") -> DataFrame:
    """Sums per key and a total row, largest first by the first measure.

    The total is a rollup of the detail sums, so the table is read once and expanded never.
    """
    detail = df.groupBy(key).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
    names = list(measures)
    rolled = detail.rollup(key).agg(F.grouping(key).alias("_total"), *[F.sum(n).alias(n) for n in names])
    return rolled.select(
        F.when(F.col("_total") == 1, F.lit(label)).otherwise(F.col(key).cast("string")).alias(key), *names
    ).orderBy(*[F.col(n).desc_nulls_last() for n in names])


def cube_rollup(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], mode: str = "cube") -> DataFrame:
    grouped = df.cube(*keys) if mode == "cube" else df.rollup(*keys)
    return grouped.agg(F.grouping_id().cast("int").alias("grouping_id"), *aggs)


def multi_source_size_report(
    sources: Sequence[DataFrame], keys: Sequence[str], measure: str, min_total=0
) -> DataFrame:
    """Sum over several sources per key, share of the grand total in whole percent, small groups left out."""
    united = sources[0].select(*keys, measure)
    for s in sources[1:]:
        united = united.union(s.select(*keys, measure))
    grouped = united.groupBy(*keys).agg(F.sum(measure).alias("total"))
    grand = grouped.agg(F.sum("total").alias("_grand"))
    return (
        grouped.crossJoin(F.broadcast(grand))
        .withColumn("percent", F.round(F.try_divide(F.col("total").cast("double") * 100, F.col("_grand").cast("double"))))
        .where(F.col("total") > min_total)
        .drop("_grand")
        .orderBy(F.col("total").desc(), *keys)
    )


def estimated_size_filter(df: DataFrame, rows: Column | str, avg_len: Column | str, max_size) -> DataFrame:
    """Rows whose ``rows * avg_len`` is below a limit, largest first, unknown sizes dropped."""
    return (
        df.withColumn("est_size", as_col(rows) * as_col(avg_len))
        .where(F.col("est_size") < F.lit(max_size))
        .orderBy(F.col("est_size").desc_nulls_last())
    )


def string_agg_distinct(
    df: DataFrame,
    keys: str | Sequence[str],
    col: str,
    values_per_part: int,
    sep: str = "; ",
    distinct: bool = True,
    name: str = "joined",
    slices: int | None = None,
) -> DataFrame:
    """Sorted values of a group as one text per ``part``.

    Part n holds the values ranked n * ``values_per_part`` up to the next multiple, counting repeats
    when ``distinct`` is off. So every group follows one rule, however the input is partitioned, and
    no cell or task holds more than that many values. Equal values are reduced to one row with a
    count before the shuffle.
    """
    keys = as_list(keys)
    rows = df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).cast("string").alias("_v")).agg(
        (F.lit(1).cast("bigint") if distinct else F.count(F.lit(1))).alias("_n")
    )
    placed = running_total(rows, ["_v"], keys, "_n", "_before", slices)
    size = F.lit(values_per_part).cast("bigint")
    end = F.col("_before") + F.col("_n")
    parts = F.sequence(F.floor(F.col("_before") / size), F.floor((end - 1) / size))
    cut = placed.withColumn("part", F.explode(parts))
    here = F.least(end, (F.col("part") + 1) * size) - F.greatest("_before", F.col("part") * size)
    values = F.sort_array(F.collect_list(F.struct("_v", here.cast("int").alias("_here"))))
    texts = F.flatten(F.transform(values, lambda x: F.array_repeat(x["_v"], x["_here"])))
    return cut.groupBy(*keys, "part").agg(F.array_join(texts, sep).alias(name))


def json_object_agg(
    df: DataFrame,
    keys: str | Sequence[str],
    k: str,
    v: str,
    values_per_part: int,
    name: str = "object",
    slices: int | None = None,
) -> DataFrame:
    """Key/value pairs of a group as one JSON object per ``part``, keys sorted; of repeated keys the
    largest value stays.

    Part n holds the keys ranked n * ``values_per_part`` up to the next multiple.
    """
    keys = as_list(keys)
    pairs = df.groupBy(*keys, F.col(k).cast("string").alias("_k")).agg(F.max(v).alias("_v"))
    placed = numbered(pairs, ["_k"], keys, "_rn", slices)
    part = F.floor((F.col("_rn") - 1) / F.lit(values_per_part)).cast("bigint")
    entries = F.sort_array(F.collect_list(F.struct("_k", "_v")))
    gather = F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"})
    return placed.groupBy(*keys, part.alias("part")).agg(gather.alias(name))


def query_to_json(
    df: DataFrame,
    group: str | Sequence[str] | None,
    order: Sequence[str],
    rows_per_part: int,
    strip_nulls: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Rows as JSON arrays, one array per group; NULL for an empty table when there is no group.

    Part n of a group holds its rows ranked n * ``rows_per_part`` up to the next multiple: together
    the parts hold every row in order, and no task or cell holds the whole group.
    """
    keys = as_list(group)
    text = F.to_json(
        F.struct(*[F.col(c) for c in df.columns if c not in keys]),
        {"ignoreNullFields": "true" if strip_nulls else "false"},
    )
    rows = numbered(df, list(order), keys, "_rn", slices).select(
        *keys, F.floor((F.col("_rn") - 1) / F.lit(rows_per_part)).cast("bigint").alias("part"), "_rn", text.alias("_json")
    )
    ordered = F.sort_array(F.collect_list(F.struct("_rn", "_json")))
    array = F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda r: r["_json"]), ","), F.lit("]"))
    parts = rows.groupBy(*keys, "part").agg(array.alias("json"))
    if keys:
        return parts
    spark = df.sparkSession
    return spark.range(1).select(F.lit(0).cast("bigint").alias("_zero")).join(
        parts.withColumn("_p", F.lit(0).cast("bigint")), F.col("_zero") == F.col("_p"), "left"
    ).select("part", "json")


def timing_summary(runs: DataFrame, name: str, sql: str, ms: str, before: str | None = None, after: str | None = None) -> DataFrame:
    """Per run set: count and lowest, mean (whole) and highest time, in ms and as text.

    A set without a name is named by its statement, with what runs before and after it.
    """
    text = F.col(sql)
    if before:
        text = F.concat(F.coalesce(F.concat(F.col(before), F.lit("; ")), F.lit("")), text)
    if after:
        text = F.concat(text, F.coalesce(F.concat(F.lit("; "), F.col(after)), F.lit("")))
    total, cnt = F.sum(F.col(ms).cast("bigint")), F.count(ms)
    grouped = runs.groupBy(F.coalesce(F.col(name), text).alias("name")).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min(ms).cast("bigint").alias("min_ms"),
        total.alias("_total"),
        cnt.alias("_n"),
        F.max(ms).cast("bigint").alias("max_ms"),
    )
    out = grouped.withColumn("avg_ms", F.expr("_total div nullif(_n, 0)"))
    for stat in ("min", "avg", "max"):
        out = out.withColumn(f"{stat}_time", format_interval(f"{stat}_ms"))
    return out.drop("_total", "_n").orderBy("avg_ms", "min_ms", "max_ms", "name")


def global_aggregates(df: DataFrame, col: str) -> DataFrame:
    """One row: count, non-null count, min, max, sum and mean."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(col).alias("cnt"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
        F.sum(col).alias("sum"),
        F.avg(col).alias("avg"),
    )


def share_of_total(df: DataFrame, measure: str, scale: int = 2, name: str = "share") -> DataFrame:
    """``x / sum(x) over () * 100``, the total being one broadcast row and no window over everything."""
    total = df.agg(F.sum(measure).alias("_total"))
    share = F.try_divide(F.col(measure).cast("double"), F.col("_total").cast("double")) * 100
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.round(share, scale)).drop("_total")


def count_over_all(df: DataFrame, name: str = "total_count") -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))))


def bar_scaled_to_max(df: DataFrame, measure: str, width: int = 50, char: str = "*", name: str = "bar") -> DataFrame:
    """A bar of ``width`` characters for the largest value, others in proportion."""
    top = df.agg(F.max(measure).alias("_top"))
    length = F.try_divide(F.col(measure).cast("double"), F.col("_top").cast("double")) * width
    bar = F.repeat(F.lit(char), F.bround(length, 0).cast("int"))
    return df.crossJoin(F.broadcast(top)).withColumn(name, bar).drop("_top")


def last_line_value(df: DataFrame, value: str, order: str, keys: str | Sequence[str] = ()) -> DataFrame:
    """The value of the last row, of the table or of every key."""
    return df.groupBy(*as_list(keys)).agg(F.max_by(value, order).alias("last_value"))
