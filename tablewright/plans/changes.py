"""Change jobs, log reports and the stream on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import changes, logs
from tablewright.plans.aggregates import GAP_SQL, interval_sql, money
from tablewright.plans.joins import GOLDEN_SQL, customers_with_golden
from tablewright.plans.registry import query
from tablewright.session import scratch_path
from tablewright.streaming.log_gap import write_log_gap


@query(
    "duplicate_status",
    f"""
    WITH c AS (SELECT c_custkey, {GOLDEN_SQL} AS golden_key FROM customer)
    SELECT c_custkey, golden_key, CAST(CASE WHEN c_custkey IN (SELECT golden_key FROM c WHERE golden_key IS NOT NULL) THEN 2
      WHEN golden_key IS NOT NULL THEN 3 ELSE 1 END AS INTEGER) AS duplicate_status
    FROM c
    """,
)
def _(t):
    rows = customers_with_golden(t).select("c_custkey", "golden_key")
    return changes.duplicate_status(rows, "c_custkey", "golden_key")


# Customers in debt go, each replaced by the customer before it: runs of them form chains.
REMAP_SQL = """
  WITH RECURSIVE pairs AS (SELECT c_custkey AS new_key, c_custkey - 1 AS old_key FROM customer WHERE c_acctbal < 2000 AND c_custkey > 0),
  walk AS (
    SELECT new_key, old_key FROM pairs
    UNION ALL SELECT w.new_key, p.old_key FROM walk w JOIN pairs p ON p.new_key = w.old_key),
  links AS (SELECT new_key, min(old_key) AS old_key FROM walk GROUP BY 1)
"""


@query(
    "key_remap_cascade",
    f"""
    {REMAP_SQL}
    SELECT 'orders' AS tbl, o_orderkey AS id, coalesce(old_key, o_custkey) AS custkey, NULL AS origin
    FROM orders LEFT JOIN links ON new_key = o_custkey
    UNION ALL
    SELECT 'events', event_id, coalesce(old_key, user_id), NULL FROM events LEFT JOIN links ON new_key = user_id
    UNION ALL
    SELECT 'customer', c_custkey, c_custkey, CASE WHEN c_custkey IN (SELECT old_key FROM links) THEN c_name ELSE 'own' END
    FROM customer WHERE c_custkey NOT IN (SELECT new_key FROM links)
    """,
)
def _(t):
    customers = t("customer").withColumn("origin", F.lit("own"))
    pairs = customers.where("c_acctbal < 2000 AND c_custkey > 0").selectExpr("c_custkey AS new_key", "c_custkey - 1 AS old_key")
    out = changes.key_remap_cascade(
        pairs,
        {"orders": (t("orders"), "o_custkey"), "events": (t("events"), "user_id")},
        customers,
        "c_custkey",
        origin=("origin", "c_name"),
    )
    none = F.lit(None).cast("string")

    def rows(name, id_col, key, origin):
        return out[name].select(
            F.lit("customer" if name == "parent" else name).alias("tbl"),
            F.col(id_col).alias("id"),
            F.col(key).alias("custkey"),
            origin.alias("origin"),
        )

    orders, events = rows("orders", "o_orderkey", "o_custkey", none), rows("events", "event_id", "user_id", none)
    return orders.union(events).union(rows("parent", "c_custkey", "c_custkey", F.col("origin")))


def deleted_orders(t):
    targets = t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    total = targets.join(t("orders"), "o_custkey").count()
    path = scratch_path(t.spark, "batched-delete")
    return changes.batched_delete(t("orders"), targets, "o_custkey", path, batch=max(1, -(-total // 6)))


@query(
    "batched_delete",
    "SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def _(t):
    return deleted_orders(t)[0]


@query(
    "batched_delete_progress",
    """
    SELECT 6 AS batches, max(n) AS total, max(n) AS deleted, 100.0::DOUBLE AS done_percent, true AS timed, 0 AS eta_ms
    FROM (SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))
    """,
)
def _(t):
    log = changes.batch_progress_log(deleted_orders(t)[1])
    last = F.max_by(F.struct("deleted", "done_percent", "eta_ms"), "step")
    return log.agg(
        F.count("*").alias("batches"), F.max("total").alias("total"), last.alias("last"),
        F.bool_and(F.col("ms") > 0).alias("timed"),
    ).select("batches", "total", "last.deleted", "last.done_percent", "timed", F.col("last.eta_ms").alias("eta_ms"))


@query(
    "update_from_join",
    """
    SELECT c_custkey, CASE WHEN top IS NOT NULL THEN top ELSE c_acctbal END AS c_acctbal,
      CASE WHEN o_custkey IS NOT NULL THEN status ELSE c_mktsegment END AS c_mktsegment
    FROM customer LEFT JOIN (
      SELECT o_custkey, max(o_totalprice) AS top, arg_max(nullif(o_orderstatus, 'P'), o_totalprice) AS ignored,
        (list(nullif(o_orderstatus, 'P') ORDER BY o_totalprice DESC))[1] AS status
      FROM orders GROUP BY 1) ON o_custkey = c_custkey * 2
    """,
)
def _(t):
    """Customers with an even key below take the values; the others stay as they are."""
    half = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey") / 2).cast("bigint")
    orders = t("orders").select(
        half.alias("c_custkey"),
        "o_totalprice",
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
    )
    return changes.update_from_join(
        t("customer").select("c_custkey", "c_acctbal", "c_mktsegment"),
        orders,
        "c_custkey",
        {"c_acctbal": "o_totalprice", "c_mktsegment": "status"},
    )


AS_OF_SQL = "TIMESTAMP '2024-03-01 00:00:00'"
SIZE_SQL = """CASE WHEN {0} < 1024 THEN printf('%.2f B', round({0}, 2))
  WHEN {0} < 1048576 THEN printf('%.2f KiB', round({0} / 1024, 2)) ELSE printf('%.2f MiB', round({0} / 1048576, 2)) END"""


def as_of():
    return F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")


def query_log(t):
    """Events read as a query log: whole value as rows read; memory and time from the value."""
    return t("events").select(
        F.col("event_id").alias("query_id"),
        F.concat_ws(" ", F.lit("SELECT"), "event_type", F.lit("FROM"), "props").alias("query"),
        F.col("ts").alias("start_time"),
        F.col("ts").alias("event_time"),
        F.floor("value").alias("read_rows"),
        F.nullif(F.col("user_id"), F.lit(0)).alias("total_rows"),
        F.floor(F.col("value") * 1000).alias("memory_usage"),
        F.floor(F.col("value") * 100).alias("duration_ms"),
    )


@query(
    "running_queries",
    f"""
    SELECT query_id, elapsed_ms, {interval_sql('elapsed_ms')} AS elapsed, percent, mem_usage FROM (
      SELECT event_id AS query_id, date_diff('microsecond', ts, {AS_OF_SQL}) // 1000 AS elapsed_ms,
        round(floor(value) / nullif(user_id, 0) * 100, 2) AS percent, {SIZE_SQL.format('CAST(floor(value * 1000) AS DOUBLE)')} AS mem_usage
      FROM events WHERE event_id <> 7)
    """,
)
def _(t):
    running = logs.running_queries(query_log(t), 7, as_of())
    return running.select("query_id", "elapsed_ms", "elapsed", "percent", "mem_usage")


@query(
    "query_log_search",
    f"""
    SELECT event_id AS query_id, 'SELECT ' || event_type || ' FROM ' || props AS query,
      {interval_sql('CAST(floor(value * 100) AS BIGINT)')} AS elapsed,
      {SIZE_SQL.format('CAST(floor(value * 1000) AS DOUBLE)')} AS mem_usage
    FROM events WHERE ('SELECT ' || event_type || ' FROM ' || props) ILIKE '%SIGNUP%'
      AND ('SELECT ' || event_type || ' FROM ' || props) NOT ILIKE '%: 6%'
    """,
)
def _(t):
    return logs.query_log_search(query_log(t), ["%SIGNUP%"], ["%: 6%"]).select("query_id", "query", "elapsed", "mem_usage")


@query(
    "workload_top",
    f"""
    SELECT event_type, user_id, calls, rows, round(CAST(t AS DOUBLE) / CAST(sum(t) OVER () AS DOUBLE) * 100, 2) AS total_time_share,
      round(CAST(t AS DOUBLE), 3) AS total_time_ms, {interval_sql('CAST(round_even(CAST(t AS DOUBLE), 0) AS BIGINT)')} AS total_time_hr,
      round(CAST(t AS DOUBLE) / calls, 3) AS avg_time_ms, CAST(rows // calls AS BIGINT) AS avg_rows
    FROM (
      SELECT event_type, any_value(0) AS user_id, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS rows,
        sum(CAST(value AS DECIMAL(18,2))) AS t
      FROM events GROUP BY 1 HAVING sum(CAST(value AS DECIMAL(18,2))) >= 1)
    """.replace("event_type, user_id, calls", "event_type, calls").replace("any_value(0) AS user_id, ", ""),
)
def _(t):
    rows = t("events").withColumn("time_ms", money("value"))
    return logs.workload_top(rows, "event_type", "time_ms", "user_id")


@query(
    "activity_ages",
    f"""
    SELECT event_id, event_type,
      {interval_sql(f"date_diff('microsecond', ts, {AS_OF_SQL}) // 1000")} AS query_time,
      {interval_sql(f"date_diff('microsecond', date_trunc('day', ts), {AS_OF_SQL}) // 1000")} AS transaction_time
    FROM events WHERE event_type NOT IN ('view')
    """,
)
def _(t):
    rows = t("events").withColumn("day", F.col("ts").cast("date").cast("timestamp_ntz"))
    ages = logs.activity_ages(
        rows, {"transaction_time": "day", "query_time": "ts"}, as_of(), ["view"], state="event_type", then=["event_id"]
    )
    return ages.select("event_id", "event_type", "query_time", "transaction_time")


PART_USE_SQL = """
  SELECT l_partkey, count(*) AS uses, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'A') AS a,
    count(*) FILTER (l_returnflag = 'N') AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity
  FROM lineitem GROUP BY 1
"""


def part_use(t):
    flags = {f: F.count_if(F.col("l_returnflag") == f.upper()).alias(f) for f in ("r", "a", "n")}
    return t("lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("uses"), *flags.values(), F.sum("l_quantity").cast("bigint").alias("quantity")
    )


@query(
    "rarely_used",
    f"""
    SELECT p_partkey, p_name, uses, r + a + n AS num_writes FROM part JOIN ({PART_USE_SQL}) ON l_partkey = p_partkey
    WHERE uses < 28 AND NOT regexp_matches(p_name, '(?i)RING|bolt')
    """,
)
def _(t):
    joined = t("part").join(part_use(t), F.col("l_partkey") == F.col("p_partkey"))
    return logs.rarely_used(joined, "uses", "p_name", ["r", "a", "n"], 28, "RING|bolt", ["p_partkey"]).select(
        "p_partkey", "p_name", "uses", "num_writes"
    )


@query(
    "usage_with_sizes",
    f"""
    SELECT p_partkey, p_retailprice, uses, quantity
    FROM part LEFT JOIN (SELECT * FROM ({PART_USE_SQL})) ON l_partkey = p_partkey * 2
    """,
)
def _(t):
    used = part_use(t).select("l_partkey", "uses", "quantity")
    parts = t("part").select("p_partkey", "p_retailprice", (F.col("p_partkey") * 2).alias("twice"))
    found = logs.usage_with_sizes(parts, used, ("twice", "l_partkey"), ["p_retailprice", "quantity"], ["p_partkey"])
    return found.drop("twice")


@query(
    "stream_log_gap",
    f"""
    SELECT event_id, user_id, prev_time, date_diff('microsecond', prev_time, ts) AS gap_us, false AS late FROM (
      SELECT g.event_id, g.user_id, g.prev_time, e.ts FROM ({GAP_SQL}) g JOIN events e USING (event_id))
    """,
)
def _(t):
    arriving = (
        t.spark.readStream.schema(t("events").schema)
        .option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", 64)
        .parquet(t.folder)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )
    target = scratch_path(t.spark, "log-gap")
    write_log_gap(arriving, "user_id", "ts", "event_id", target, scratch_path(t.spark, "log-gap-state"))
    out = t.spark.read.parquet(target)
    return out.select("event_id", "user_id", F.col("prev_time").cast("timestamp_ntz"), "gap_us", "late")


ARRIVALS, MOST_LATE = 5, 6 * 3600  # files, and seconds that a message is late at most


@query(
    "stream_log_gap_late",
    f"""
    SELECT event_id, user_id, prev_time, date_diff('microsecond', prev_time, ts) AS gap_us FROM (
      SELECT g.event_id, g.user_id, g.prev_time, e.ts FROM ({GAP_SQL}) g JOIN events e USING (event_id))
    """,
)
def _(t):
    """Messages come up to six hours late, in five arrivals; a last one, of no user, closes the log."""
    events = t("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    late = F.make_dt_interval(secs=F.pmod(F.xxhash64("event_id"), F.lit(MOST_LATE)))
    spans = events.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    share = (F.unix_micros(F.col("ts") + late) - F.unix_micros("first")) / (
        F.unix_micros("last") + MOST_LATE * 1_000_000 - F.unix_micros("first") + 1
    )
    folder = scratch_path(t.spark, "late-log")
    arrival = F.floor(share * ARRIVALS).cast("int")
    dealt = events.join(F.broadcast(spans)).select("event_id", "user_id", "ts", arrival.alias("arrival"))
    closing = spans.select(
        F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("bigint").alias("user_id"),
        (F.col("last") + F.expr("INTERVAL 30 DAYS")).alias("ts"),
    )
    for i in range(ARRIVALS):
        dealt.where(F.col("arrival") == i).drop("arrival").coalesce(1).write.mode("append").parquet(folder)
    closing.coalesce(1).write.mode("append").parquet(folder)
    arriving = t.spark.readStream.schema(closing.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    target = scratch_path(t.spark, "log-gap")
    write_log_gap(arriving, "user_id", "ts", "event_id", target, scratch_path(t.spark, "log-gap-state"), f"{MOST_LATE} seconds")
    out = t.spark.read.parquet(target)
    return out.select("event_id", "user_id", F.col("prev_time").cast("timestamp_ntz"), "gap_us")
