"""Array columns and wide-to-long reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.stemming import with_stems

from tablewright.functions.text import readable_size


def array_explode_ordinal(df: DataFrame, arr: str) -> DataFrame:
    """One row per element with its 1-based position."""
    others = [c for c in df.columns if c != arr]
    return df.select(*others, F.posexplode(arr).alias("_pos", "elem")).withColumn(
        "rn", (F.col("_pos") + 1).cast("bigint")
    ).drop("_pos")


def array_column_sum(df: DataFrame, arr: str, as_array: bool = True, cast: str | None = None) -> DataFrame:
    """Element-wise sum over all rows; short arrays and NULL elements add nothing.

    Partial sums leave every task as one row per position. The array form gathers those, so it is
    as long as the longest array of the table.
    """
    elem = F.col("elem").cast(cast) if cast else F.col("elem")
    sums = array_explode_ordinal(df.select(arr), arr).groupBy("rn").agg(F.sum(elem).alias("sum_elem"))
    if not as_array:
        return sums.orderBy("rn")
    ordered = F.sort_array(F.collect_list(F.struct("rn", "sum_elem")))
    return sums.agg(F.transform(ordered, lambda s: s["sum_elem"]).alias("sums"))


def wide_to_long_metrics(
    df: DataFrame, metrics: Sequence[str], per: str | None = None, sizes: Sequence[str] = (), keys: Sequence[str] = ()
) -> DataFrame:
    """One row of metrics as (metric, value, pretty, per_row) rows.

    Metrics named in ``sizes`` are bytes: they get a readable text and their share per row of ``per``.
    """
    values = df.select(
        *keys,
        *[F.col(m).cast("double").alias(m) for m in metrics],
        (F.col(per).cast("double") if per else F.lit(None).cast("double")).alias("_per"),
    )
    long = values.unpivot([*keys, "_per"], list(metrics), "metric", "value")
    is_size = F.col("metric").isin(*sizes) if sizes else F.lit(False)
    return (
        long.withColumn("pretty", F.when(is_size, readable_size("value")))
        .withColumn("per_row", F.when(is_size, F.try_divide(F.col("value"), F.col("_per"))))
        .drop("_per")
    )


def row_hash(df: DataFrame, cols: Sequence[str] | None = None, method: str = "md5", name: str = "row_hash") -> DataFrame:
    """A hash column over all columns or a subset.

    ``md5`` hashes the row as JSON with NULLs written out and is the same on any engine; ``xxhash64``
    is faster and adds a NULL flag per column, since it would skip NULLs.
    """
    chosen: list[Column] = [F.col(c) for c in (cols or df.columns)]
    if method == "md5":
        value = F.md5(F.to_json(F.struct(*chosen), {"ignoreNullFields": "false"}))
    elif method == "xxhash64":
        value = F.xxhash64(*chosen, *[c.isNull() for c in chosen])
    else:
        raise ValueError("method must be md5 or xxhash64")
    return df.withColumn(name, value)


def row_to_json(df: DataFrame, drop: Sequence[str] = (), name: str = "row_json") -> DataFrame:
    """Every row as JSON text with NULLs kept."""
    kept = [F.col(c) for c in df.columns if c not in set(drop)]
    return df.select(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias(name))


def tsvector_tokens(
    df: DataFrame, id_col: str, text: str, stop_words: Sequence[str] | None = None, positions: bool = True
) -> DataFrame:
    """Search tokens of a text.

    Plain form: the sorted distinct words, as written, between white space. Position form: one row
    per lower-case word with all its positions, stop words counted but left out; :func:`tsvector_stems`
    gives stems. Everything happens inside the row of the text; no word is shuffled.
    """
    if not positions:
        words = F.array_remove(F.split(F.col(text), r"\s+"), "")
        return df.select(id_col, F.sort_array(F.array_distinct(words)).alias("tokens"))
    words = F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")
    placed = F.transform(words, lambda w, i: F.struct(w.alias("w"), (i + 1).alias("at")))
    if stop_words:
        placed = F.filter(placed, lambda p: ~p["w"].isin(*stop_words))
    placed = F.sort_array(placed)
    # Equal words stand together now: a run starts where the word before is another one.
    starts = F.filter(
        F.transform("_placed", lambda p, i: F.when(~p["w"].eqNullSafe(F.get("_placed", i - 1)["w"]), i)),
        lambda i: i.isNotNull(),
    )
    end = lambda k: F.coalesce(F.get("_starts", k + 1), F.size("_placed"))
    runs = F.transform(
        "_starts",
        lambda start, k: F.struct(
            F.get("_placed", start)["w"].alias("lexeme"),
            F.transform(F.slice("_placed", start + 1, end(k) - start), lambda p: p["at"]).alias("positions"),
        ),
    )
    rows = df.select(id_col, placed.alias("_placed")).withColumn("_starts", starts)
    return rows.select(id_col, F.inline(runs))


def tsvector_stems(df: DataFrame, id_col: str, text: str, stop_words: Sequence[str] = ()) -> DataFrame:
    """Search tokens under their English stems: (id, lexeme, positions), stop words counted but left out.

    Every distinct word of the table is stemmed once; a dictionary that is small enough is broadcast by
    the optimizer. Positions are put together per text and stem within each task, then shuffled.
    """
    words = F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")
    found = df.select(id_col, F.posexplode(words).alias("_at", "_word"))
    if stop_words:
        found = found.where(~F.col("_word").isin(*stop_words))
    stems = with_stems(found.select(F.col("_word").alias("_known")).distinct(), "_known", "lexeme")
    named = found.join(stems, F.col("_word") == F.col("_known"))
    return named.groupBy(id_col, "lexeme").agg(F.sort_array(F.collect_list(F.col("_at") + 1)).alias("positions"))


def metric_table(df: DataFrame, aggs: Mapping[str, Column]) -> DataFrame:
    """One row with named aggregates, as input for :func:`wide_to_long_metrics`."""
    return df.agg(*[c.alias(n) for n, c in aggs.items()])
