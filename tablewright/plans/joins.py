"""Joins on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import joins as j
from tablewright.operators.paging import deep_page
from tablewright.plans.registry import query

PAGE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, c_name, n_name, r_name, p_name, s_name"


def star_dims(t):
    c = F.col
    return [
        (t("orders"), c("o_orderkey") == c("l_orderkey")),
        (t("customer"), c("c_custkey") == c("o_custkey")),
        (t("nation"), c("n_nationkey") == c("c_nationkey")),
        (t("region"), c("r_regionkey") == c("n_regionkey")),
        (t("part"), c("p_partkey") == c("l_partkey")),
        (t("supplier"), c("s_suppkey") == c("l_suppkey")),
    ]


@query(
    "star_join_paged",
    f"""
    SELECT {PAGE} FROM lineitem
    JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 20 OFFSET 40
    """,
)
def _(t):
    cols = PAGE.split(", ")
    return j.star_join_paged(t("lineitem"), star_dims(t), cols[:5], 20, 40, cols)


@query(
    "star_join_deep_page",
    f"""
    WITH star AS (
      SELECT {PAGE}, l_extendedprice FROM lineitem
      JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
      JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
      JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
    SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS position
    FROM star ORDER BY position LIMIT 30 OFFSET (SELECT count(*) * 2 // 3 FROM star)
    """,
)
def _(t):
    """The page at two thirds of the joined lines: dimensions are joined to its slice only."""
    cols = [*PAGE.split(", "), "l_extendedprice"]
    star = j.star_join(t("lineitem"), star_dims(t), cols)
    return deep_page(star, [*cols[:5], "l_extendedprice"], 30, lambda rows: rows * 2 // 3, joined=True)


@query(
    "left_join_chain",
    """
    SELECT c_custkey, o_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey
    LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus
    """,
)
def _(t):
    steps = [
        (t("orders"), [("c_custkey", "o_custkey")]),
        (t("lineitem"), [("o_orderkey", "l_orderkey"), ("o_orderstatus", "l_linestatus")]),
    ]
    return j.left_join_chain(t("customer"), steps).select(
        "c_custkey", "o_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"
    )


@query(
    "distinct_join_filter",
    """
    SELECT DISTINCT c_custkey, c_mktsegment, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey
    WHERE o_orderstatus = 'F' AND o_totalprice > 200000 ORDER BY ALL LIMIT 200
    """,
)
def _(t):
    cols = ["c_custkey", "c_mktsegment", "o_orderpriority"]
    return j.distinct_join_filter(
        t("orders"),
        t("customer"),
        F.col("c_custkey") == F.col("o_custkey"),
        (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000),
        cols,
        cols,
        200,
    )


@query(
    "correlated_counts",
    """
    SELECT o_orderkey,
      (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned,
      (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') AS open_lines,
      (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O' AND l_returnflag = 'R')
        AS open_returned
    FROM orders
    """,
)
def _(t):
    returned, is_open = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    counts = {"returned": returned, "open_lines": is_open, "open_returned": is_open & returned}
    return j.correlated_counts(t("orders").select("o_orderkey"), t("lineitem"), ("o_orderkey", "l_orderkey"), counts)


@query(
    "correlated_top1",
    """
    SELECT o_orderkey, (
      SELECT min(CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_linestatus = 'O' THEN 2 WHEN l_quantity > 25 THEN 3 ELSE 0 END)
      FROM lineitem WHERE l_orderkey = o_orderkey) AS weight
    FROM orders
    """,
)
def _(t):
    weight = (
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_linestatus") == "O", 2).when(F.col("l_quantity") > 25, 3).otherwise(0)
    )
    return j.correlated_top1(
        t("orders").select("o_orderkey"), t("lineitem"), ("o_orderkey", "l_orderkey"), weight, "weight"
    )


@query(
    "lateral_table_per_row",
    """
    SELECT c_custkey, top_price, orders FROM customer LEFT JOIN LATERAL (
      SELECT max(o_totalprice) AS top_price, count(*) AS orders FROM orders
      WHERE o_custkey = c_custkey * 2 HAVING count(*) > 0) ON true
    """,
)
def _(t):
    """Half of the customers look for a key that no order has."""
    customers = t("customer").select("c_custkey", (F.col("c_custkey") * 2).alias("twice"))
    return j.lateral_table_per_row(
        customers,
        t("orders"),
        ("twice", "o_custkey"),
        [F.max("o_totalprice").alias("top_price"), F.count(F.lit(1)).alias("orders")],
    ).drop("twice")


@query(
    "full_outer_by_key",
    """
    SELECT s_suppkey, s_name, c_custkey, c_name
    FROM (SELECT s_suppkey * 20 AS s_suppkey, s_name FROM supplier) FULL OUTER JOIN customer ON s_suppkey = c_custkey
    """,
)
def _(t):
    suppliers = t("supplier").select((F.col("s_suppkey") * 20).alias("s_suppkey"), "s_name")
    customers = t("customer").select("c_custkey", "c_name")
    return j.full_outer_by_key(suppliers, customers, ("s_suppkey", "c_custkey"))


@query(
    "one_sided_keys",
    """
    SELECT o_orderkey AS key, 'orders' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL
    SELECT l_orderkey, 'lineitem' FROM lineitem WHERE l_orderkey NOT IN (
      SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
      AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
    UNION ALL
    SELECT doc_id, 'documents' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL
    SELECT doc_id, 'labels' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
    """,
)
def _(t):
    orders = j.one_sided_keys(t("orders"), t("lineitem"), ("o_orderkey", "l_orderkey"), ("orders", "lineitem"))
    docs = j.one_sided_keys(t("documents"), t("labels"), ("doc_id", "doc_id"), ("documents", "labels"))
    return orders.union(docs)


@query(
    "anti_join_candidates",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE c_acctbal > -5000
      AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
      AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT'
                      AND o_orderdate < DATE '1997-01-01')
    """,
)
def _(t):
    pending = t("orders").where("o_orderstatus = 'P'")
    urgent = t("orders").where("o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'")
    key = ("c_custkey", "o_custkey")
    return j.anti_join_candidates(t("customer"), F.col("c_acctbal") > -5000, [(pending, key), (urgent, key)]).select(
        "c_custkey", "c_name"
    )


@query("not_in_subquery", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return j.not_in_subquery(t("documents").select("doc_id", "lang"), "doc_id", t("labels"), "doc_id")


@query(
    "or_condition_join",
    """
    SELECT s_suppkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
    FROM supplier JOIN lineitem ON l_partkey = s_suppkey OR l_suppkey = s_suppkey
    """,
)
def _(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return j.or_condition_join(t("supplier").select("s_suppkey"), "s_suppkey", lines, ("l_partkey", "l_suppkey"))


SHORT_SQL = "CASE WHEN p_size < 25 THEN p_type ELSE p_type || '.' || p_brand END"


@query(
    "lookup_exact_or_prefix_join",
    f"""
    SELECT p_partkey, p_size, short, type_name
    FROM (SELECT p_partkey, p_size, {SHORT_SQL} AS short FROM part)
    LEFT JOIN (
      SELECT DISTINCT p_size + p_size % 3 AS level, p_type AS type_key, lower(p_type) AS type_name FROM part
      UNION ALL
      SELECT DISTINCT p_size, p_type || '.' || p_brand, p_brand FROM part)
    ON level = p_size AND (short = type_key OR split_part(short, '.', 1) = type_key)
    """,
)
def _(t):
    part = t("part")
    rows = part.select("p_partkey", "p_size", F.expr(SHORT_SQL).alias("short"))
    plain = part.selectExpr("p_size + p_size % 3 AS level", "p_type AS type_key", "lower(p_type) AS type_name")
    full = part.selectExpr("p_size", "p_type || '.' || p_brand", "p_brand")
    lookup = plain.distinct().union(full.distinct())
    return j.lookup_exact_or_prefix_join(rows, lookup, ("p_size", "level"), "short", "type_key", ["type_name"])


GOLDEN_SQL = "CASE WHEN c_custkey % 5 = 0 AND c_custkey > 0 THEN c_custkey - 1 END"


def customers_with_golden(t):
    return t("customer").withColumn("golden_key", F.expr(GOLDEN_SQL))


@query(
    "self_join_pairs",
    f"""
    SELECT o.c_custkey AS old_c_custkey, o.c_name AS old_c_name, n.c_custkey AS new_c_custkey, n.c_name AS new_c_name
    FROM (SELECT *, {GOLDEN_SQL} AS golden_key FROM customer) o JOIN customer n
      ON o.golden_key = n.c_custkey AND o.c_custkey <> n.c_custkey
    """,
)
def _(t):
    return j.self_join_pairs(customers_with_golden(t), "golden_key", "c_custkey", "c_custkey", ["c_name"])


@query(
    "nonequi_self_join_count",
    """
    SELECT count(*) AS pairs FROM customer a JOIN customer b ON a.c_custkey <> b.c_custkey
      AND a.c_mktsegment = 'BUILDING' AND b.c_mktsegment = 'BUILDING'
    """,
)
def _(t):
    return j.nonequi_self_join_count(t("customer"), "c_custkey", F.col("c_mktsegment") == "BUILDING").select(
        F.col("pairs").cast("bigint")
    )


REPORT = ("### Pressing", "1-URGENT", "2-HIGH", "### Rest", "5-LOW", "4-NOT SPECIFIED", "unknown")


@query(
    "ordered_lookup_report",
    f"""
    SELECT CAST(ordinal AS INTEGER) AS ordinal, name, cnt, top_price
    FROM (SELECT unnest(['{"', '".join(REPORT)}']) AS name, generate_subscripts(['{"', '".join(REPORT)}'], 1) AS ordinal)
    LEFT JOIN (SELECT o_orderpriority, count(*) AS cnt, max(o_totalprice) AS top_price FROM orders GROUP BY 1)
      ON o_orderpriority = name
    ORDER BY ordinal
    """,
)
def _(t):
    per_priority = t("orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("cnt"), F.max("o_totalprice").alias("top_price")
    )
    return j.ordered_lookup_report(REPORT, per_priority, "o_orderpriority")


@query(
    "audit_join_lookup",
    """
    SELECT e.event_id, coalesce(a.tablename, e.event_type) AS table_name, CAST(e.user_id AS VARCHAR) AS base_id,
      c.c_name, n.n_name, 'app:/customers/' || CAST(e.user_id AS VARCHAR) AS url
    FROM events e
    LEFT JOIN (SELECT DISTINCT event_type AS relid, 'customer' AS tablename FROM events
               WHERE event_type IN ('click', 'error')) a ON a.relid = e.event_type
    JOIN customer c ON c.c_custkey = e.user_id
    JOIN nation n ON n.n_nationkey = c.c_nationkey
    WHERE coalesce(a.tablename, e.event_type) = 'customer'
    """,
)
def _(t):
    events = t("events")
    audit = events.select(
        "event_id", F.col("event_type").alias("relid"), F.create_map(F.lit("id"), F.col("user_id").cast("string")).alias("row_data")
    )
    alias = events.where(F.col("event_type").isin("click", "error")).select(
        F.col("event_type").alias("relid"), F.lit("customer").alias("tablename")
    ).distinct()
    return j.audit_join_lookup(
        audit,
        alias,
        t("customer"),
        t("nation"),
        "app:/customers/",
        base_key="c_custkey",
        base_link="c_nationkey",
        lookup_key="n_nationkey",
        target_kind="customer",
    ).select("event_id", "table_name", "base_id", "c_name", "n_name", "url")
