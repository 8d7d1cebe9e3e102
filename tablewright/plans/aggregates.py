"""Grouping, ordered rows, histograms and arrays on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import aggregates as agg
from tablewright.operators import arrays as arr
from tablewright.operators import histograms as hist
from tablewright.operators import windows as win
from tablewright.plans.registry import query
from tablewright.plans.scans import LINES_SQL, document_lines


def money(c: str):
    return F.col(c).cast("decimal(18,2)")


@query(
    "group_having_collect",
    """
    SELECT l_orderkey, count(*) AS cnt, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS members
    FROM lineitem GROUP BY 1 HAVING count(*) < 3
    """,
)
def _(t):
    return agg.group_having_collect(t("lineitem"), "l_orderkey", "l_linenumber", 3, ",")


@query(
    "duplicate_groups",
    """
    SELECT cnt, total_size, ids[1] AS idx1, ids[2] AS idx2, ids[3] AS idx3, ids[4] AS idx4 FROM (
      SELECT count(*) AS cnt, CAST(sum(n_chars) AS BIGINT) AS total_size, list(doc_id ORDER BY doc_id) AS ids
      FROM documents GROUP BY text, lang HAVING count(*) > 1)
    """,
)
def _(t):
    return agg.duplicate_groups(t("documents"), ["text", "lang"], "doc_id", "n_chars")


@query(
    "conditional_sums",
    """
    SELECT l_partkey, count(*) AS cnt, count(*) FILTER (l_returnflag = 'R') AS returned,
      count(*) FILTER (l_quantity > 25) AS bulky, bool_or(l_tax = 0) AS any_untaxed
    FROM lineitem GROUP BY 1
    """,
)
def _(t):
    return agg.conditional_sums(
        t("lineitem"),
        "l_partkey",
        {"returned": F.col("l_returnflag") == "R", "bulky": F.col("l_quantity") > 25},
        {"any_untaxed": F.col("l_tax") == 0},
    )


@query(
    "ratio_of_sums",
    """
    SELECT user_id, CAST(a AS DOUBLE) AS sum_a, CAST(b AS DOUBLE) AS sum_b,
      CAST(a AS DOUBLE) / nullif(CAST(a + b AS DOUBLE), 0) AS ratio
    FROM (
      SELECT user_id, sum(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS a,
        sum(CASE WHEN event_type = 'view' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS b
      FROM events GROUP BY 1)
    """,
)
def _(t):
    def only(kind):
        return F.when(F.col("event_type") == kind, money("value")).otherwise(F.lit(0).cast("decimal(18,2)"))

    out = agg.ratio_of_sums(t("events"), only("click"), only("view"), "user_id")
    return out.withColumn("sum_a", F.col("sum_a").cast("double")).withColumn("sum_b", F.col("sum_b").cast("double"))


@query(
    "total_row_report",
    """
    WITH d AS (
      SELECT n_name, count(*) AS customers, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS balance
      FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
    SELECT n_name, customers, CAST(balance AS DOUBLE) AS balance FROM d
    UNION ALL SELECT 'TOTAL', CAST(sum(customers) AS BIGINT), CAST(sum(balance) AS DOUBLE) FROM d
    """,
)
def _(t):
    rows = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    report = agg.total_row_report(rows, "n_name", {"balance": money("c_acctbal"), "customers": F.lit(1)})
    return report.select("n_name", F.col("customers").cast("bigint"), F.col("balance").cast("double"))


@query(
    "cube_rollup",
    """
    SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS INTEGER) AS grouping_id,
      count(*) AS cnt, sum(l_quantity) AS quantity
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
    """,
)
def _(t):
    return agg.cube_rollup(
        t("lineitem"), ["l_returnflag", "l_linestatus"], [F.count(F.lit(1)).alias("cnt"), F.sum("l_quantity").alias("quantity")]
    )


@query(
    "multi_source_size_report",
    """
    WITH u AS (
      SELECT c_nationkey AS nationkey, 'customer' AS kind, CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer
      UNION ALL SELECT s_nationkey, 'supplier', CAST(s_acctbal AS DECIMAL(18,2)) FROM supplier
      UNION ALL SELECT c_nationkey, 'order', CAST(o_totalprice AS DECIMAL(18,2)) FROM orders
        JOIN customer ON c_custkey = o_custkey),
    g AS (SELECT nationkey, kind, sum(balance) AS total FROM u GROUP BY ALL)
    SELECT nationkey, kind, CAST(total AS DOUBLE) AS total,
      round(CAST(total AS DOUBLE) * 100 / (SELECT CAST(sum(total) AS DOUBLE) FROM g)) AS percent
    FROM g WHERE total > 10000
    """,
)
def _(t):
    orders = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))

    def source(df, nation, kind, amount):
        return df.select(F.col(nation).alias("nationkey"), F.lit(kind).alias("kind"), money(amount).alias("balance"))

    sources = [
        source(t("customer"), "c_nationkey", "customer", "c_acctbal"),
        source(t("supplier"), "s_nationkey", "supplier", "s_acctbal"),
        source(orders, "c_nationkey", "order", "o_totalprice"),
    ]
    report = agg.multi_source_size_report(sources, ["nationkey", "kind"], "balance", 10000)
    return report.withColumn("total", F.col("total").cast("double"))


@query(
    "estimated_size_filter",
    """
    SELECT * FROM (
      SELECT source, lang, count(*) AS rows, CAST(floor(avg(n_chars)) AS BIGINT) AS avg_len,
        count(*) * CAST(floor(avg(n_chars)) AS BIGINT) AS est_size
      FROM documents GROUP BY 1, 2)
    WHERE est_size < 30000
    """,
)
def _(t):
    sizes = t("documents").groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("rows"), F.floor(F.avg("n_chars")).alias("avg_len")
    )
    return agg.estimated_size_filter(sizes, "rows", "avg_len", 30000)


@query(
    "string_agg_distinct",
    """
    SELECT p_brand, part, string_agg(p_type, '; ' ORDER BY p_type) AS types
    FROM (
      SELECT p_brand, p_type, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1) // 3 AS BIGINT) AS part
      FROM (SELECT DISTINCT p_brand, p_type FROM part))
    GROUP BY 1, 2
    """,
)
def _(t):
    return agg.string_agg_distinct(t("part"), "p_brand", "p_type", values_per_part=3, name="types", slices=4)


@query(
    "json_object_agg",
    """
    SELECT o_custkey, part, '{' || string_agg('"' || k || '":"' || v || '"', ',' ORDER BY k) || '}' AS statuses
    FROM (
      SELECT *, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY k) - 1) // 5 AS BIGINT) AS part
      FROM (SELECT o_custkey, CAST(o_orderdate AS DATE)::VARCHAR AS k, max(o_orderstatus) AS v FROM orders GROUP BY 1, 2))
    GROUP BY 1, 2
    """,
)
def _(t):
    rows = t("orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return agg.json_object_agg(rows, "o_custkey", "day", "o_orderstatus", values_per_part=5, name="statuses")


def interval_sql(ms: str) -> str:
    """``HH:MM:SS.mmm`` of milliseconds that are not negative."""
    return (
        f"printf('%02d:%02d:%02d.%03d', ({ms}) // 3600000, (({ms}) // 60000) % 60, "
        f"(({ms}) // 1000) % 60, ({ms}) % 1000)"
    )


@query(
    "timing_summary",
    f"""
    SELECT name, cnt, min_ms, avg_ms, max_ms, {interval_sql("min_ms")} AS min_time, {interval_sql("avg_ms")} AS avg_time,
      {interval_sql("max_ms")} AS max_time
    FROM (
      SELECT coalesce(CASE WHEN event_type NOT IN ('click', 'error') THEN event_type END, 'begin; select ' || user_id) AS name,
        count(*) AS cnt, min(ms) AS min_ms, CAST(sum(ms) // count(ms) AS BIGINT) AS avg_ms, max(ms) AS max_ms
      FROM (SELECT *, CAST(round(value * 1000) AS BIGINT) AS ms FROM events)
      GROUP BY 1)
    """,
)
def _(t):
    kind = F.col("event_type")
    runs = t("events").select(
        F.when(~kind.isin("click", "error"), kind).alias("run_name"),
        F.lit("begin").alias("sql_before"),
        F.concat(F.lit("select "), F.col("user_id").cast("string")).alias("sql"),
        F.round(F.col("value") * 1000).cast("bigint").alias("ms"),
    )
    return agg.timing_summary(runs, "run_name", "sql", "ms", before="sql_before")


@query(
    "global_aggregates",
    """
    SELECT count(*) AS rows, count(nullif(l_quantity, 50)) AS cnt, min(nullif(l_quantity, 50)) AS min,
      max(nullif(l_quantity, 50)) AS max, sum(nullif(l_quantity, 50)) AS sum, round(avg(nullif(l_quantity, 50)), 9) AS avg
    FROM lineitem
    """,
)
def _(t):
    rows = t("lineitem").select(F.nullif(F.col("l_quantity"), F.lit(50.0)).alias("q"))
    return agg.global_aggregates(rows, "q").withColumn("avg", F.round("avg", 9))


GAP_SQL = f"""
  SELECT event_id, user_id, rn, prev_time, gap_ms, {interval_sql("gap_ms")} AS gap FROM (
    SELECT *, date_diff('microsecond', prev_time, ts) // 1000 AS gap_ms FROM (
      SELECT *, row_number() OVER w AS rn, lag(ts) OVER w AS prev_time
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
"""
GAP_COLS = ["event_id", "user_id", "rn", "prev_time", "gap_ms", "gap"]


@query("log_gap", GAP_SQL)
def _(t):
    return win.log_gap(t("events"), "ts", "event_id", "user_id", slices=8).select(*GAP_COLS)


@query("log_gap_global", GAP_SQL.replace("PARTITION BY user_id ", ""))
def _(t):
    return win.log_gap(t("events"), "ts", "event_id", slices=8).select(*GAP_COLS)


TAIL_SQL = f"SELECT * FROM (SELECT *, max(rn) OVER (PARTITION BY user_id) AS m FROM ({GAP_SQL})) WHERE rn > m - 20 AND rn >= 3"


@query("log_tail", f"SELECT {', '.join(GAP_COLS)} FROM ({TAIL_SQL})")
def _(t):
    return win.log_tail(t("events"), "ts", "event_id", 20, "user_id", from_row=3).select(*GAP_COLS)


@query(
    "row_number_plain",
    "SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
)
def _(t):
    return win.row_number_plain(t("orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], slices=8)


@query(
    "share_of_total",
    """
    SELECT o_custkey, CAST(total AS DOUBLE) AS total, round(CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE) * 100, 4) AS share
    FROM (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY 1)
    """,
)
def _(t):
    totals = t("orders").groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("total"))
    return agg.share_of_total(totals, "total", 4).withColumn("total", F.col("total").cast("double"))


@query("count_over_all", "SELECT p_partkey, p_name, count(*) OVER () AS total_count FROM part")
def _(t):
    return agg.count_over_all(t("part").select("p_partkey", "p_name"))


@query(
    "bar_scaled_to_max",
    """
    SELECT p_type, p_brand, cnt, repeat('*', CAST(round_even(cnt / max(cnt) OVER () * 50, 0) AS INTEGER)) AS bar
    FROM (SELECT p_type, p_brand, count(*) AS cnt FROM part GROUP BY 1, 2)
    """,
)
def _(t):
    return agg.bar_scaled_to_max(t("part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("cnt")), "cnt")


@query("last_line_value", f"SELECT doc_id, arg_max(line, line_no) AS last_value FROM ({LINES_SQL}) GROUP BY 1")
def _(t):
    return agg.last_line_value(document_lines(t), "line", "line_no", "doc_id")


@query(
    "equi_width_histogram",
    """
    WITH e AS (SELECT epoch_us(o_orderdate) / CAST(1000000 AS DOUBLE) AS x FROM orders),
    m AS (SELECT min(x) AS lo, max(x) AS hi FROM e)
    SELECT CASE WHEN x >= hi THEN 6 ELSE CAST(floor(5.0::DOUBLE * (x - lo) / (hi - lo)) AS BIGINT) + 1 END AS bucket,
      count(*) AS cnt, repeat('=', CAST(round_even(count(*) / 10.0::DOUBLE, 0) AS INTEGER)) AS bar
    FROM e, m GROUP BY 1
    """,
)
def _(t):
    return hist.equi_width_histogram(t("orders"), "o_orderdate", 5, rows_per_char=10)


BUCKETS_SQL = """
  WITH b AS (SELECT generate_series(min(o_orderdate), max(o_orderdate), INTERVAL {months} MONTH) AS bounds FROM orders)
  SELECT o_orderkey, o_orderdate, bucket, bounds[bucket] AS range_lower,
    CASE WHEN bucket < len(bounds) THEN bounds[bucket + 1] END AS range_upper
  FROM (SELECT o.*, bounds, CAST(len([x for x in bounds if x <= o_orderdate]) AS BIGINT) AS bucket FROM orders o, b)
"""


@query("boundary_bucket", BUCKETS_SQL.format(months=1))
def _(t):
    return hist.boundary_bucket(t("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "1 month")


MONTH_END_SQL = """
  WITH o AS (SELECT o_orderkey, o_orderdate FROM orders
             UNION ALL SELECT -1, min(o_orderdate) - INTERVAL 1 DAY FROM orders),
  b AS (SELECT generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 MONTH) AS bounds FROM o)
  SELECT o_orderkey, o_orderdate, bucket, bounds[bucket] AS range_lower,
    CASE WHEN bucket < len(bounds) THEN bounds[bucket + 1] END AS range_upper
  FROM (SELECT o.*, bounds, CAST(len([x for x in bounds if x <= o_orderdate]) AS BIGINT) AS bucket FROM o, b)
"""


@query("boundary_bucket_month_end", MONTH_END_SQL)
def _(t):
    """The lowest date is the 31st: boundaries fall to the 28th and stay there."""
    orders = t("orders").select("o_orderkey", "o_orderdate")
    day = F.timestamp_add("DAY", F.lit(-1), F.min("o_orderdate"))
    first = orders.agg(F.lit(-1).cast("bigint").alias("o_orderkey"), day.alias("o_orderdate"))
    return hist.boundary_bucket(orders.union(first), "o_orderdate", "1 month")


@query(
    "list_bucket",
    """
    SELECT o_orderkey, o_totalprice,
      CAST(len([x for x in [1000.0, 50000, 50000.5, 250000] if x <= o_totalprice]) AS BIGINT) AS bucket
    FROM orders
    """,
)
def _(t):
    return hist.list_bucket(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", [250000.0, 1000.0, 50000.0, 50000.5])


@query(
    "calendar_histogram",
    f"""
    SELECT bucket, cnt, total_count, range_lower, range_upper,
      repeat('■', CAST(cnt AS INTEGER)) AS bar, cnt * 100.0::DOUBLE / total_count AS percent,
      repeat('■', CAST(round_even(cnt * 100.0::DOUBLE / total_count, 0) AS INTEGER)) AS bar_percent
    FROM (
      SELECT bucket, range_lower, range_upper, count(*) AS cnt, (SELECT count(*) FROM orders) AS total_count
      FROM ({BUCKETS_SQL.format(months=6)}) GROUP BY ALL)
    """,
)
def _(t):
    return hist.calendar_histogram(t("orders"), "o_orderdate", "6 months")


@query(
    "length_histogram",
    """
    WITH l AS (SELECT length(text) AS len FROM documents), m AS (SELECT min(len) AS lo, max(len) AS hi FROM l),
    h AS (
      SELECT CASE WHEN len >= hi THEN 20 ELSE CAST(floor(19.0::DOUBLE * (len - lo) / (hi - lo)) AS BIGINT) + 1 END AS bucket,
        CAST(min(len) AS INTEGER) AS min_len, CAST(max(len) AS INTEGER) AS max_len, count(*) AS amount
      FROM l, m GROUP BY 1)
    SELECT *, repeat('*', CAST(round_even(amount / max(amount) OVER () * 50, 0) AS INTEGER)) AS bar FROM h
    """,
)
def _(t):
    return hist.length_histogram(t("documents"), "text")


@query(
    "array_explode_ordinal",
    "SELECT vec_id, unnest(embedding) AS elem, CAST(generate_subscripts(embedding, 1) AS BIGINT) AS rn FROM embeddings",
)
def _(t):
    return arr.array_explode_ordinal(t("embeddings").select("vec_id", "embedding"), "embedding")


SUMS_SQL = """
  SELECT rn, CAST(sum(elem) AS BIGINT) AS sum_elem FROM (
    SELECT generate_subscripts(embedding, 1) AS rn, unnest([CAST(floor(x::DOUBLE * 10000) AS BIGINT) for x in embedding]) AS elem
    FROM embeddings)
  GROUP BY 1
"""


def scaled_embeddings(t):
    return t("embeddings").select(
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 10000)).alias("arr")
    )


@query("array_column_sum", f"SELECT string_agg(sum_elem::VARCHAR, ',' ORDER BY rn) AS sums FROM ({SUMS_SQL})")
def _(t):
    return arr.array_column_sum(scaled_embeddings(t), "arr").select(
        F.array_join(F.col("sums").cast("array<string>"), ",").alias("sums")
    )


@query("array_column_sum_rows", SUMS_SQL)
def _(t):
    return arr.array_column_sum(scaled_embeddings(t), "arr", as_array=False)


@query(
    "wide_to_long_metrics",
    """
    WITH m AS (
      SELECT source, count(*) AS ct, sum(n_chars) AS chars, sum(strlen(text)) AS bytes FROM documents GROUP BY 1),
    l AS (
      SELECT source, ct, unnest(['chars', 'bytes', 'ct']) AS metric,
        unnest([CAST(chars AS DOUBLE), CAST(bytes AS DOUBLE), CAST(ct AS DOUBLE)]) AS value FROM m)
    SELECT source, metric, value,
      CASE WHEN metric = 'bytes' THEN
        CASE WHEN value < 1024 THEN printf('%.2f B', round(value, 2))
             WHEN value < 1048576 THEN printf('%.2f KiB', round(value / 1024, 2))
             WHEN value < 1073741824 THEN printf('%.2f MiB', round(value / 1048576, 2))
             ELSE printf('%.2f GiB', round(value / 1073741824, 2)) END END AS pretty,
      CASE WHEN metric = 'bytes' THEN value / ct END AS per_row
    FROM l
    """,
)
def _(t):
    metrics = t("documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("ct"), F.sum("n_chars").alias("chars"), F.sum(F.octet_length("text")).alias("bytes")
    )
    return arr.wide_to_long_metrics(metrics, ["chars", "bytes", "ct"], "ct", ["bytes"], ["source"])
