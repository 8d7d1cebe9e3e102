"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.ordered import as_list


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def ilike_filter(df: DataFrame, col: str, like: Sequence[str] = (), not_like: Sequence[str] = ()) -> DataFrame:
    """Rows matching every ``like`` and none of ``not_like``, in any letter case."""
    wanted = [F.col(col).ilike(p) for p in like]
    unwanted = [~F.col(col).ilike(p) for p in not_like]
    return df.where(_all(wanted + unwanted))


def regex_filter(df: DataFrame, col: str, pattern: str, negate: bool = False, ignore_case: bool = True) -> DataFrame:
    """Rows in which the pattern is found (or not). Word borders are written ``\\b``."""
    hit = F.col(col).rlike(("(?iu)" if ignore_case else "") + pattern)
    return df.where(~hit if negate else hit)


def in_list_filter(df: DataFrame, col: str, values: Sequence, negate: bool = False) -> DataFrame:
    """``IN`` or ``NOT IN`` a literal list, SQL rules for NULL included."""
    hit = F.col(col).isin(*values)
    return df.where(~hit if negate else hit)


def none_equal_filter(df: DataFrame, array_col: str, value) -> DataFrame:
    """``value <> ALL (array)``: no element equals the value; a NULL element leaves it unknown."""
    return df.where(F.forall(F.col(array_col), lambda x: x != F.lit(value)))


def not_latest_version(df: DataFrame, version_col: str, partition: str | Sequence[str] | None = None) -> DataFrame:
    """Rows whose version is below the highest one, of the table or of their key.

    The maximum is aggregated map-side and joined back, so a key of any size stays spread out.
    """
    keys = as_list(partition)
    top = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max(version_col).alias("_top"))
    if not keys:
        return df.crossJoin(F.broadcast(top)).where(F.col(version_col) != F.col("_top")).drop("_top")
    on = _all([df[k].eqNullSafe(top[f"_k_{k}"]) for k in keys])
    joined = df.join(top, on & (df[version_col] != top["_top"]), "inner")
    return joined.drop("_top", *[f"_k_{k}" for k in keys])


def audit_key_search(
    df: DataFrame,
    kind_col: str,
    map_col: str,
    rules: Sequence[tuple[str | None, str, object]],
    has_key: str | None = None,
) -> DataFrame:
    """Row images in which one of several rules holds.

    A rule ``(kind, key, values)`` asks that the row is of that kind (any, when None) and that
    ``map[key]`` is one of the values. ``has_key`` asks in addition that the map holds that key.
    """
    image = F.col(map_col)
    hits = None
    for kind, key, values in rules:
        wanted = [values] if isinstance(values, str) else list(values)
        rule = F.try_element_at(image, F.lit(key)).isin(*wanted)
        if kind is not None:
            rule = (F.col(kind_col) == kind) & rule
        hits = rule if hits is None else hits | rule
    if has_key is not None:
        present = F.map_contains_key(image, has_key)
        hits = present if hits is None else hits & present
    return df.where(hits)


def unordered_limit(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """The first n rows. An order is asked for, so that the answer can be repeated."""
    return df.orderBy(*order).limit(n)


def top_k_sorted(df: DataFrame, order: Sequence[Column | str], k: int = 20) -> DataFrame:
    return df.orderBy(*order).limit(k)


def offset_paging(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def nulls_placement(df: DataFrame, col: str, desc: bool = True, nulls: str = "first", then: Sequence = ()) -> DataFrame:
    """Sort with NULLs put first or last by name rather than by the default of the engine."""
    c = F.col(col)
    keys = {
        (True, "first"): c.desc_nulls_first(),
        (True, "last"): c.desc_nulls_last(),
        (False, "first"): c.asc_nulls_first(),
        (False, "last"): c.asc_nulls_last(),
    }
    return df.orderBy(keys[desc, nulls], *then)


def union_all_sources(*dfs: DataFrame) -> DataFrame:
    """``UNION ALL`` by position."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.union(d)
    return out


def union_distinct(*dfs: DataFrame) -> DataFrame:
    return union_all_sources(*dfs).distinct()


def select_distinct(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return (df.select(*cols) if cols else df).distinct()


def regex_groups(df: DataFrame, col: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """One column per capture group; rows without a match drop out, as a set-returning match does.

    An optional group that took no part is an empty string.
    """
    groups = [F.regexp_extract(col, pattern, i).alias(n) for i, n in enumerate(names, start=1)]
    return df.where(F.col(col).rlike(pattern)).select("*", *groups)
