"""JSON trees as rows, and row-by-row comparison of two tables.

A document is taken apart inside its row, level by level, and exploded once; only documents nested deeper
than a few levels are put down in between, as often as their depth asks for.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.predicates import null_safe_compare
from tablewright.functions.variants import json_delete, json_merge, json_set, json_type, path_steps
from tablewright.session import cut_lineage

# The paths that tell of a row on one side only.
MISSING_ONE = "<one row missing>"
MISSING_TWO = "<two row missing>"


# Children of a tree node {path, v, odd}: members of an object, items of an array, none of a scalar.
# ``odd`` marks nodes below a key that itself holds a dot or a bracket.
_NODE_CHILDREN = """
  coalesce(
    transform(map_entries(try_cast(n.v AS map<string, variant>)), e -> named_struct(
      'path', concat(n.path, '.', e.key), 'v', e.value,
      'odd', n.odd OR contains(e.key, '.') OR contains(e.key, '['))),
    transform(try_cast(n.v AS array<variant>), (x, i) -> named_struct(
      'path', concat(n.path, '[', i, ']'), 'v', x, 'odd', n.odd)),
    filter(array(n), z -> false))
"""

# Children of a pair {path, one, two, a, b} that both sides have and whose text differs: an equal subtree
# is left at once. ``a`` and ``b`` are the texts, made once per node.
_PAIR_CHILDREN = """
  coalesce(
    transform(
      map_entries(map_zip_with(
        try_cast(n.one AS map<string, variant>), try_cast(n.two AS map<string, variant>),
        (k, x, y) -> named_struct('one', x, 'two', y, 'a', cast(x AS string), 'b', cast(y AS string)))),
      e -> named_struct(
        'path', concat(n.path, '.', e.key), 'one', e.value.one, 'two', e.value.two, 'a', e.value.a, 'b', e.value.b)),
    transform(
      zip_with(
        try_cast(n.one AS array<variant>), try_cast(n.two AS array<variant>),
        (x, y) -> named_struct('one', x, 'two', y, 'a', cast(x AS string), 'b', cast(y AS string))),
      (z, i) -> named_struct('path', concat(n.path, '[', i, ']'), 'one', z.one, 'two', z.two, 'a', z.a, 'b', z.b)),
    filter(array(n), z -> false))
"""
_DIFFERING_CHILDREN = f"filter({_PAIR_CHILDREN}, e -> e.a <> e.b)"

LEVELS = 8  # levels unfolded inside a row before it is put down
_ROW, _DEPTH = "_row", "_depth"


def nesting_depth(text: Column, most: int) -> Column:
    """How deep objects and lists of a JSON text are nested, counted up to ``most``.

    Strings go first, then everything but brackets; every step takes away the innermost pairs.
    """
    plain = F.regexp_replace(text, r"(?s)\\.", "")
    brackets = F.regexp_replace(plain, r"\"[^\"]*\"|[^\[\]{}\"]+", "")
    start = F.struct(brackets.alias("left"), F.lit(0).alias("depth"))

    def peel(state: Column, _: Column) -> Column:
        left = F.regexp_replace(state["left"], r"\{\}|\[\]", "")
        return F.struct(left.alias("left"), (state["depth"] + F.when(state["left"] != "", 1).otherwise(0)).alias("depth"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, peel, lambda state: state["depth"])


def _unfolded(df: DataFrame, children: str, levels: int) -> DataFrame:
    """Add ``_level1`` and so on below ``_level0``; a level is worked out once, from the one above."""
    for depth in range(1, levels + 1):
        df = df.selectExpr("*", f"flatten(transform(_level{depth - 1}, n -> {children})) AS _level{depth}")
    return df


def _descend(df: DataFrame, root: Column, children: str, text: Column) -> list[DataFrame]:
    """``df`` with ``_nodes``, every node below the root, in one part or several.

    Documents nested up to ``LEVELS`` deep are unfolded inside their row, by as many levels as the deepest
    has. Of deeper ones the nodes that are still open are put down after each ``LEVELS`` levels, until none
    is; their rows come in parts of their own, with a row number that tells the documents apart.
    """
    names = [f"`{c}`" for c in df.columns]
    rows = df.withColumn(_DEPTH, nesting_depth(text, LEVELS + 1)).withColumn("_level0", F.array(root))
    deepest = rows.agg(F.max(_DEPTH)).first()[0] or 0

    def nodes(of: DataFrame, levels: int) -> Column:
        return F.flatten(F.array(*[F.col(f"_level{d}") for d in range(1, levels + 1)])).alias("_nodes")

    few = max(1, min(deepest, LEVELS))
    flat = _unfolded(rows.where(F.col(_DEPTH) <= LEVELS), children, few)
    parts = [flat.select(*names, F.lit(None).cast("long").alias(_ROW), nodes(flat, few))]
    if deepest <= LEVELS:
        return parts
    deep = rows.where(F.col(_DEPTH) > LEVELS).withColumn(_ROW, F.monotonically_increasing_id())
    still_open = cut_lineage(deep.select(*names, _ROW, "_level0"))
    while not still_open.isEmpty():
        out = _unfolded(still_open, children, LEVELS)
        parts.append(out.select(*names, _ROW, nodes(out, LEVELS)))
        rest = F.expr(f"filter(_level{LEVELS}, n -> size({children}) > 0)")
        still_open = cut_lineage(out.select(*names, _ROW, rest.alias("_level0")).where(F.size("_level0") > 0))
    return parts


def json_path_flatten(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Every node of a JSON document as (path, value, type), like ``.A[0][0].C``; the root is left out.

    Inner nodes are rows too, with their JSON text as value; a JSON null has a NULL value. Depth has no
    limit. The input is read for its depth first: hand over a stored table, not a long computation.
    """
    root = F.struct(F.lit("").alias("path"), F.parse_json(json_col).alias("v"), F.lit(False).alias("odd"))
    rows = F.transform(
        F.col("_nodes"),
        lambda n: F.struct(n["path"].alias("path"), n["v"].cast("string").alias("value"), json_type(n["v"]).alias("type")),
    )
    # Two nodes share a path only where a key itself holds a dot or a bracket.
    odd = F.exists(F.col("_nodes"), lambda n: n["odd"])
    flat, *deep = _descend(df.select(id_col, json_col), root, _NODE_CHILDREN, F.col(json_col))
    found = flat.select(id_col, F.inline(F.when(odd, F.array_distinct(rows)).otherwise(rows)))
    if not deep:
        return found
    whole = reduce(DataFrame.unionByName, [part.select(id_col, _ROW, F.inline(rows)) for part in deep])
    return found.unionByName(whole.distinct().drop(_ROW))


def json_set_merge_delete(
    df: DataFrame,
    json_col: str,
    set: Mapping[str, Column] | None = None,
    merge: str | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Edit a JSON text column: merge an object into it, set values by path, remove paths, in that order.

    ``set`` values are columns; they become JSON values of their type.
    """
    # One column per step: an edit names its input more than once, and nesting would double it each time.
    out, v = df.withColumn("_json", F.parse_json(json_col)), F.col("_json")
    if merge is not None:
        out = out.withColumn("_json", json_merge(v, F.parse_json(F.lit(merge))))
    for path, value in (set or {}).items():
        out = out.withColumn("_json", json_set(v, path, value.cast("variant")))
    for path in drop:
        out = out.withColumn("_json", json_delete(v, path))
    return out.withColumn(json_col, F.to_json("_json")).drop("_json")


def _changes(one: str, two: str, cols: Sequence[str]) -> Column:
    """JSON object of the changed columns. Each piece is text, so that an unchanged column leaves none."""
    pieces = []
    for c in cols:
        old, new = F.col(f"{two}.{c}"), F.col(f"{one}.{c}")
        values = F.to_json(F.struct(old.alias("old"), new.alias("new")), {"ignoreNullFields": "false"})
        pieces.append(F.when(null_safe_compare(old, new), F.concat(F.lit(json.dumps(c) + ":"), values)))
    return F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))


def table_diff_shallow(one: DataFrame, two: DataFrame, key: str, ignore: Sequence[str] = ()) -> DataFrame:
    """Per id in both tables a JSON object ``{column: {old, new}}`` of the changed columns.

    ``old`` is the value of the second table, ``new`` that of the first. Rows without a change are
    dropped; ignored columns are neither compared nor read.
    """
    cols = [c for c in one.columns if c in set(two.columns) - {key, *ignore}]
    left, right = one.select(key, *cols).alias("one"), two.select(key, *cols).alias("two")
    joined = left.join(right, F.col(f"one.{key}") == F.col(f"two.{key}"), "inner")
    diff = _changes("one", "two", cols)
    return joined.select(F.col(f"one.{key}").alias(key), diff.alias("data_diff")).where(F.col("data_diff") != "{}")


def table_diff_lateral(one: DataFrame, two: DataFrame, key: str, ignore: Sequence[str] = ()) -> DataFrame:
    """The diff with ignored columns taken out before comparing and empty results filtered.

    Both forms prune ignored columns from the scan here, so they share one plan.
    """
    return table_diff_shallow(one, two, key, ignore)


def row_documents(df: DataFrame, key: str, json_cols: Sequence[str] = (), ignore_paths: Sequence[str] = ()) -> DataFrame:
    """(key, document): whole rows as JSON values, JSON text columns nested and not quoted.

    Ignored top-level columns are not read; deeper paths are removed from the document.
    """
    steps = [(p, path_steps(p)) for p in ignore_paths]
    top = {s[0] for _, s in steps if len(s) == 1}
    fields = [
        F.parse_json(c).alias(c) if c in json_cols else F.col(c) for c in df.columns if c not in top
    ]
    doc = F.parse_json(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    out = df.select(key, doc.alias("document"))
    for path, s in steps:
        if len(s) > 1:
            out = out.withColumn("document", json_delete(F.col("document"), path))
    return out


def _changed_paths(pairs: DataFrame, key: str) -> DataFrame:
    """Rows (key, one, two) to one row per changed path present on both sides."""
    texts = pairs.withColumn("_a", F.col("one").cast("string")).withColumn("_b", F.col("two").cast("string"))
    root = F.struct(F.lit("").alias("path"), "one", "two", F.col("_a").alias("a"), F.col("_b").alias("b"))
    rows = F.transform(
        F.col("_nodes"),
        lambda n: F.struct(n["path"].alias("change_path"), n["a"].alias("one_value"), n["b"].alias("two_value")),
    )
    # Paths below the depth of one side are not on both.
    parts = _descend(texts.where("_a <> _b"), root, _DIFFERING_CHILDREN, F.col("_a"))
    return reduce(DataFrame.unionByName, [part.select(key, F.inline(rows)) for part in parts])


def table_diff_deep(
    one: DataFrame,
    two: DataFrame,
    key: str,
    ignore_paths: Sequence[str] = (),
    json_cols: Sequence[str] = (),
) -> DataFrame:
    """Changed JSON paths of rows in both tables: (id, change_path, one_value, two_value).

    A path on one side only is not reported, nor one with a JSON null on a side. Both documents of
    an id are walked together after the one join on the id; equal subtrees are not entered. Depth has no
    limit; the join is done once to find the depth and once for the answer, unless it is stored before.
    """
    left = row_documents(one, key, json_cols).select(F.col(key), F.col("document").alias("one"))
    right = row_documents(two, key, json_cols).select(F.col(key).alias("_key"), F.col("document").alias("two"))
    pairs = left.join(right, left[key] == right["_key"], "inner").drop("_key")
    out = _changed_paths(pairs, key)
    return out.where(~F.col("change_path").isin(*ignore_paths)) if ignore_paths else out


def table_diff_deep_limited(
    one: DataFrame,
    two: DataFrame,
    key: str,
    ignore_paths: Sequence[str] = (),
    limit: int = 100,
    json_cols: Sequence[str] = (),
) -> DataFrame:
    """Deep diff of the first ``limit`` changed rows by id, and every row that one side lacks.

    Digests are joined to find changed ids, once; whole documents move only for the rows in the answer, and
    only those are made again. Ignored paths are removed before comparing.
    """

    def documents(df: DataFrame) -> DataFrame:
        return row_documents(df, key, json_cols, ignore_paths)

    digest = F.sha2(F.to_json("document"), 256)
    a = documents(one).select(F.col(key).alias("_id"), digest.alias("_one"))
    b = documents(two).select(F.col(key).alias("_id2"), digest.alias("_two"))
    changed = cut_lineage(
        a.join(b, F.col("_id") == F.col("_id2"), "inner")
        .where(F.col("_one") != F.col("_two"))
        .select("_id")
        .orderBy("_id")
        .limit(limit)
    )
    wanted = F.broadcast(changed)

    def chosen(df: DataFrame) -> DataFrame:
        return documents(df.join(wanted, df[key] == wanted["_id"], "inner").select(*[df[c] for c in df.columns]))

    left = chosen(one).select(F.col(key), F.col("document").alias("one"))
    right = chosen(two).select(F.col(key).alias("_key"), F.col("document").alias("two"))
    pairs = cut_lineage(left.join(right, F.col(key) == F.col("_key"), "inner").drop("_key"))
    deep = _changed_paths(pairs, key)
    nothing = F.lit(None).cast("string")

    def lone(side: DataFrame, other: DataFrame, label: str, is_one: bool) -> DataFrame:
        known = other.select(F.col(key).alias("_known"))
        rest = documents(side.join(known, side[key] == known["_known"], "left_anti"))
        text = F.to_json("document")
        return rest.select(
            key,
            F.lit(label).alias("change_path"),
            (text if is_one else nothing).alias("one_value"),
            (nothing if is_one else text).alias("two_value"),
        )

    return (
        deep.union(lone(one, two, MISSING_TWO, True))
        .union(lone(two, one, MISSING_ONE, False))
        .orderBy(key, "change_path")
    )


def diff_key_uniqueness(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """Guard before a diff, empty when all is well: ids that occur more than once, per side."""

    def repeated(df: DataFrame, side: str) -> DataFrame:
        counts = df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("cnt"))
        return counts.where("cnt > 1").select(F.lit(side).alias("side"), "key", "cnt")

    return repeated(one, "one").union(repeated(two, "two"))


def diff_row_counts(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """One row: rows of both sides and how many ids differ between them."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in one.columns]), {"ignoreNullFields": "false"}), 256)
    a = one.select(F.col(key).alias("_a"), digest.alias("_one"))
    b = two.select(F.col(key).alias("_b"), digest.alias("_two"))
    differed = a.join(b, F.col("_a") == F.col("_b"), "inner").agg(
        F.count_if(F.col("_one") != F.col("_two")).alias("differed_rows")
    )
    return (
        one.agg(F.count(F.lit(1)).alias("rows_in_one"))
        .crossJoin(F.broadcast(two.agg(F.count(F.lit(1)).alias("rows_in_two"))))
        .crossJoin(F.broadcast(differed))
    )
