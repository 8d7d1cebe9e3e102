"""Sources, sinks, filters, sorts and set operations on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.predicates import (
    delta_flag,
    derived_virtual_column,
    null_safe_compare,
    searched_case,
    try_cast_default,
)
from tablewright.functions.variants import json_get
from tablewright.operators import filters as flt
from tablewright.operators.aggregates import query_to_json
from tablewright.operators.paging import deep_page
from tablewright.plans.registry import query
from tablewright.session import scratch_path
from tablewright.sources import tables as src
from tablewright.sources.refresh import refresh_copy, start_copy
from tablewright.sources.text import copy_dump, dump_line_filter, text_lines_numbered

LINES_SQL = """
  SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
"""


def document_lines(t):
    return text_lines_numbered(t("documents").select("doc_id", "text"), "text")


@query("text_lines_numbered", LINES_SQL)
def _(t):
    return document_lines(t)


@query("union_numbered_tables", "SELECT * FROM orders")
def _(t):
    orders = t("orders")
    parts = {f"orders{i}": orders.where(F.col("o_orderstatus") == s) for i, s in enumerate("FOP", start=1)}
    return src.union_numbered_tables({**parts, "orders_all": orders, "old_orders1": orders}, "orders")


@query(
    "table_copy_verified",
    """
    SELECT 'orders' AS table_name, count(*) AS source_rows, count(*) AS copy_rows, true AS same FROM orders
    UNION ALL SELECT 'customer', count(*), count(*), true FROM customer
    """,
)
def _(t):
    checks = []
    for name in ("orders", "customer"):
        _copy, check = src.table_copy_verified(t(name), scratch_path(t.spark, f"copy-{name}"), name)
        checks.append(check.drop("estimated_bytes"))
    return flt.union_all_sources(*checks)


@query(
    "table_copy_refreshed",
    """
    WITH m AS (SELECT max(o_orderkey) AS top FROM orders)
    SELECT o_orderstatus, count(*) AS orders, sum(o_orderkey) AS keys,
      CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2)) + CASE WHEN edited THEN 1 ELSE 0 END) AS DOUBLE) AS price, true AS same, true AS few_moved
    FROM (SELECT *, o_orderkey BETWEEN top * 40 // 100 AND top * 41 // 100 AS edited FROM orders, m)
    WHERE NOT (edited AND o_custkey % 4 = 0)
    GROUP BY o_orderstatus
    """,
)
def _(t):
    """A copy of orders after one stretch of 1% was edited, in part deleted: few ranges are written again."""
    path = scratch_path(t.spark, "refreshed")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", price.alias("price"))
    start_copy(orders, path, "o_orderkey", ranges=64, name="orders")
    top = orders.agg(F.max("o_orderkey")).first()[0] or 0
    edited = F.col("o_orderkey").between(top * 40 // 100, top * 41 // 100)
    later = orders.where(~(edited & (F.col("o_custkey") % 4 == 0))).withColumn(
        "price", (F.col("price") + F.when(edited, 1).otherwise(0)).cast("decimal(18,2)")
    )
    copy, checks = refresh_copy(later, path, "o_orderkey", "orders")
    moved = F.sum(F.when(F.col("moved"), F.col("source_rows")).otherwise(0))
    verdict = checks.agg(F.bool_and("same").alias("same"), (moved * 10 <= F.sum("source_rows")).alias("few_moved"))
    sums = copy.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_orderkey").alias("keys"), F.sum("price").cast("double").alias("price")
    )
    return sums.crossJoin(F.broadcast(verdict))


@query(
    "dump_line_filter",
    f"SELECT * FROM ({LINES_SQL}) WHERE NOT regexp_matches(line, '^[[:space:]]*$|[0-9]|^(CREATE|DROP) ')",
)
def _(t):
    return dump_line_filter(document_lines(t), r"^\s*$|[0-9]|^(CREATE|DROP) ")


@query(
    "inline_relation",
    """
    SELECT w.weight, o.o_orderpriority, count(*) AS cnt
    FROM orders o
    JOIN (VALUES ('1-URGENT', 5), ('2-HIGH', 3), ('5-LOW', 1)) AS w(priority, weight)
      ON w.priority = o.o_orderpriority
    GROUP BY ALL
    """,
)
def _(t):
    weights = src.inline_relation(
        t.spark, [("1-URGENT", 5), ("2-HIGH", 3), ("5-LOW", 1)], "priority string, weight int"
    )
    joined = t("orders").join(F.broadcast(weights), F.col("priority") == F.col("o_orderpriority"))
    return joined.groupBy("weight", "o_orderpriority").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "query_to_json",
    """
    SELECT o_custkey, part,
           '[' || string_agg(CAST(to_json({'o_orderkey': o_orderkey, 'priority': priority}) AS VARCHAR),
                             ',' ORDER BY o_orderkey) || ']' AS json
    FROM (
      SELECT o_custkey, o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority,
             CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS BIGINT) AS part
      FROM orders)
    GROUP BY o_custkey, part
    """,
)
def _(t):
    rows = t("orders").select(
        "o_custkey", "o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority")
    )
    return query_to_json(rows, "o_custkey", ["o_orderkey"], rows_per_part=4, slices=4)


@query(
    "searched_case",
    """
    SELECT c_custkey,
      CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'normal' ELSE 'rich' END AS band,
      CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS segment_no
    FROM customer
    """,
)
def _(t):
    balance, segment = F.col("c_acctbal"), F.col("c_mktsegment")
    return t("customer").select(
        "c_custkey",
        searched_case([(balance < 0, "debt"), (balance < 5000, "normal")], "rich").alias("band"),
        searched_case([(segment == "BUILDING", 1), (segment == "MACHINERY", 2)], 0).alias("segment_no"),
    )


@query(
    "derived_virtual_column",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
      0 + coalesce(l_quantity, 0) + coalesce(nullif(l_discount, 0), 0)
        + coalesce(CASE WHEN l_returnflag = 'R' THEN l_tax END, 0) AS total
    FROM lineitem
    """,
)
def _(t):
    returned_tax = F.when(F.col("l_returnflag") == "R", F.col("l_tax"))
    total = derived_virtual_column("l_quantity", F.nullif(F.col("l_discount"), F.lit(0.0)), returned_tax)
    return t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", total.alias("total"))


@query("ilike_filter", "SELECT * FROM part WHERE p_name ILIKE '%RING%' AND p_name NOT ILIKE 'Small%'")
def _(t):
    return flt.ilike_filter(t("part"), "p_name", ["%RING%"], ["Small%"])


@query(
    "regex_filter",
    r"SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?i)(^|[^\pL])(the|is) [a-z]+ing([^\pL]|$)')",
)
def _(t):
    return flt.regex_filter(t("documents"), "text", r"(^|[^\pL])(the|is) [a-z]+ing([^\pL]|$)").select("doc_id", "lang")


@query(
    "text_file_lines",
    f"SELECT line, count(*) AS cnt, true AS numbered FROM ({LINES_SQL}) GROUP BY 1",
)
def _(t):
    """Texts written as files and read back line by line; the numbers of a file have no gap."""
    path = scratch_path(t.spark, "lines")
    t("documents").select("text").where("text IS NOT NULL").write.text(path)
    lines = text_lines_numbered(path, spark=t.spark)
    files = lines.groupBy("file").agg((F.max("line_no") + 1 == F.countDistinct("line_no")).alias("whole"))
    sound = files.agg(F.bool_and("whole").alias("numbered"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("cnt")).crossJoin(F.broadcast(sound))


@query(
    "dump_copy_packed",
    f"SELECT line, count(*) AS cnt FROM ({LINES_SQL}) WHERE NOT regexp_matches(line, '[0-9]') GROUP BY 1",
)
def _(t):
    """A text dump copied without some lines, packed, and read back."""
    path, target = scratch_path(t.spark, "dump"), scratch_path(t.spark, "dump-copy")
    t("documents").select("text").where("text IS NOT NULL").write.text(path)
    copy_dump(t.spark, path, target, "[0-9]", lines_per_part=1000)
    return t.spark.read.text(target).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("cnt"))


@query("numbered_files", "SELECT * FROM orders")
def _(t):
    """Stored tables house1, house2, ... put together again; others in the folder are left alone."""
    path = scratch_path(t.spark, "houses")
    orders = t("orders")
    for number, status in enumerate(("F", "O", "P"), 1):
        orders.where(F.col("o_orderstatus") == status).write.parquet(f"{path}/house{number}")
    orders.limit(5).write.parquet(f"{path}/housekeeping")
    return src.read_numbered_files(t.spark, path, "house")


@query(
    "none_equal_filter",
    """
    SELECT o_custkey, len(statuses) AS n FROM (
      SELECT o_custkey, list(DISTINCT o_orderstatus) AS statuses FROM orders GROUP BY 1)
    WHERE NOT list_contains(statuses, 'P')
    """,
)
def _(t):
    held = t("orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("statuses"))
    return flt.none_equal_filter(held, "statuses", "P").select("o_custkey", F.size("statuses").cast("bigint").alias("n"))


@query(
    "in_list_filter",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') "
    "AND o_orderstatus IN ('F', 'O')",
)
def _(t):
    low = flt.in_list_filter(t("orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"], negate=True)
    return flt.in_list_filter(low, "o_orderstatus", ["F", "O"]).select("o_orderkey", "o_orderpriority")


@query(
    "not_latest_version",
    """
    SELECT o_orderkey, o_custkey, o_orderdate FROM (
      SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS latest FROM orders)
    WHERE o_orderdate <> latest
    """,
)
def _(t):
    return flt.not_latest_version(t("orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate", "o_custkey")


@query(
    "not_latest_version_global",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate NOT IN (SELECT max(o_orderdate) FROM orders)",
)
def _(t):
    return flt.not_latest_version(t("orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@query(
    "null_safe_compare",
    """
    SELECT o_orderkey, o_orderstatus, line_status, o_orderstatus IS DISTINCT FROM line_status AS differs
    FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS line_status FROM lineitem GROUP BY 1)
      ON l_orderkey = o_orderkey
    """,
)
def _(t):
    status = t("lineitem").groupBy("l_orderkey").agg(F.max("l_linestatus").alias("line_status"))
    joined = t("orders").join(status, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    differs = null_safe_compare("o_orderstatus", "line_status")
    return joined.select("o_orderkey", "o_orderstatus", "line_status", differs.alias("differs"))


TEXT_NUMBER_SQL = """
  CASE event_type WHEN 'error' THEN 'n/a' WHEN 'click' THEN NULL ELSE json_extract_string(props, '$.k') END
"""


@query(
    "try_cast_default",
    f"""
    SELECT event_id, txt, CASE WHEN txt IS NOT NULL THEN coalesce(try_cast(txt AS INTEGER), -1) END AS number
    FROM (SELECT event_id, {TEXT_NUMBER_SQL} AS txt FROM events)
    """,
)
def _(t):
    kind = F.col("event_type")
    txt = searched_case([(kind == "error", "n/a"), (kind == "click", None)], json_get("props", ".k"))
    rows = t("events").select("event_id", txt.alias("txt"))
    return rows.withColumn("number", try_cast_default("txt", "int", -1))


@query(
    "audit_key_search",
    """
    SELECT event_id, event_type, props FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
    WHERE (event_type = 'error' AND k IN ('1', '2', '3')) OR (event_type = 'click' AND k = '69') OR k = '89'
    """,
)
def _(t):
    rows = t("events").withColumn("image", F.from_json("props", "map<string,string>"))
    rules = [("error", "k", ["1", "2", "3"]), ("click", "k", "69"), (None, "k", ["89"])]
    return flt.audit_key_search(rows, "event_type", "image", rules, has_key="k").select("event_id", "event_type", "props")


@query("top_k_sorted", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(t):
    return flt.top_k_sorted(t("orders"), [F.col("o_totalprice").desc(), "o_orderkey"], 20)


@query("offset_paging", "SELECT * FROM part ORDER BY p_name, p_partkey LIMIT 25 OFFSET 50")
def _(t):
    return flt.offset_paging(t("part"), ["p_name", "p_partkey"], 25, 50)


LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query(
    "deep_page",
    f"""
    SELECT *, row_number() OVER (ORDER BY {", ".join(LINE_KEYS)}) - 1 AS position FROM lineitem
    ORDER BY {", ".join(LINE_KEYS)} LIMIT 100 OFFSET (SELECT count(*) // 2 FROM lineitem)
    """,
)
def _(t):
    """The page in the middle of all lines."""
    lines = t("lineitem")
    return deep_page(lines, LINE_KEYS, 100, lines.count() // 2)


@query(
    "deep_page_last",
    """
    SELECT o_orderkey, o_orderdate, count(*) OVER () - row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position
    FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 1000
    """,
)
def _(t):
    return deep_page(t("orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 50, 1000, descending=True)


NULLS_SQL = """
  SELECT o_orderkey, max_price FROM orders
  LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS max_price FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  ORDER BY max_price DESC NULLS FIRST, o_orderkey
"""


@query("nulls_placement", NULLS_SQL)
def _(t):
    top = t("lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("max_price"))
    joined = t("orders").join(top, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "max_price")
    return flt.nulls_placement(joined, "max_price", True, "first", ["o_orderkey"])


@query("unordered_limit", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20")
def _(t):
    return flt.unordered_limit(t("orders").select("o_orderkey", "o_custkey"), 20, ["o_orderkey"])


@query(
    "union_all_sources",
    """
    SELECT 'customer' AS kind, c_nationkey AS nationkey, c_name AS name FROM customer
    UNION ALL SELECT 'supplier', s_nationkey, s_name FROM supplier
    UNION ALL SELECT 'part', NULL, p_name FROM part
    UNION ALL SELECT 'event', NULL, event_type FROM events
    """,
)
def _(t):
    none = F.lit(None).cast("int")
    return flt.union_all_sources(
        t("customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name")),
        t("supplier").select(F.lit("supplier"), "s_nationkey", "s_name"),
        t("part").select(F.lit("part"), none, "p_name"),
        t("events").select(F.lit("event"), none, "event_type"),
    )


@query(
    "union_distinct",
    "SELECT l_partkey AS key FROM lineitem UNION SELECT l_suppkey FROM lineitem UNION SELECT o_custkey FROM orders",
)
def _(t):
    lines = t("lineitem")
    return flt.union_distinct(
        lines.select(F.col("l_partkey").alias("key")), lines.select("l_suppkey"), t("orders").select("o_custkey")
    )


@query("select_distinct", "SELECT DISTINCT l_partkey, l_returnflag, l_linestatus FROM lineitem")
def _(t):
    return flt.select_distinct(t("lineitem"), ["l_partkey", "l_returnflag", "l_linestatus"])


@query(
    "regex_groups",
    r"""
    SELECT p_partkey, regexp_extract(p_name, '^(\w+) (\w*)ing$', 1) AS colour,
           regexp_extract(p_name, '^(\w+) (\w*)ing$', 2) AS stem
    FROM part WHERE regexp_matches(p_name, '^(\w+) (\w*)ing$')
    """,
)
def _(t):
    return flt.regex_groups(t("part").select("p_partkey", "p_name"), "p_name", r"^(\w+) (\w*)ing$", ["colour", "stem"]).drop("p_name")


@query(
    "delta_flag",
    """
    SELECT o_orderkey, coalesce(lines, 0) - 4 AS delta,
      CASE WHEN coalesce(lines, 0) - 4 > 0 THEN 'large' ELSE 'OK' END AS flag
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    """,
)
def _(t):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    joined = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    cnt = F.coalesce(F.col("lines"), F.lit(0))
    return joined.select("o_orderkey", (cnt - 4).alias("delta"), delta_flag(cnt, F.lit(4), "large", "OK").alias("flag"))
