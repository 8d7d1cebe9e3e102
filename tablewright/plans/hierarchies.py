"""Hierarchies, checks over all tables, periods and matching on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import hierarchy as tree
from tablewright.operators import matching, quality
from tablewright.operators import windows as win
from tablewright.plans.registry import TABLES, query

EDGES_SQL = "SELECT p_partkey AS member, p_partkey // 3 AS role FROM part WHERE p_partkey > 0"
CLOSURE_SQL = f"""
  WITH RECURSIVE e AS ({EDGES_SQL}), r AS (
    SELECT member, role, member || ' ➫ ' || role AS path FROM e
    UNION ALL SELECT r.member, e.role, r.path || ' ➫ ' || e.role FROM r JOIN e ON e.member = r.role)
  SELECT member, role, path FROM r
  UNION ALL SELECT p_partkey, NULL, '' FROM part WHERE p_partkey NOT IN (SELECT member FROM e)
"""


def part_edges(t):
    return t("part").where("p_partkey > 0").selectExpr("p_partkey AS member", "p_partkey div 3 AS role")


@query("membership_closure", CLOSURE_SQL)
def _(t):
    return tree.membership_closure(part_edges(t), "member", "role", t("part").select("p_partkey"))


@query(
    "effective_grants",
    f"""
    SELECT g.*, c.member, c.role, c.path
    FROM (SELECT p_partkey AS grantee, p_brand AS table_name, p_type AS privilege FROM part) g
    JOIN ({CLOSURE_SQL}) c ON g.grantee = c.member OR g.grantee = c.role
    """,
)
def _(t):
    grants = t("part").selectExpr("p_partkey AS grantee", "p_brand AS table_name", "p_type AS privilege")
    return tree.effective_grants(part_edges(t), t("part").select("p_partkey"), grants)


@query("reachable_pairs", f"SELECT DISTINCT member, role FROM ({CLOSURE_SQL}) WHERE role IS NOT NULL")
def _(t):
    return tree.reachable_pairs(part_edges(t), "member", "role")


@query(
    "effective_grant_pairs",
    f"""
    SELECT DISTINCT g.*, c.member, c.role
    FROM (SELECT p_partkey AS grantee, p_brand AS table_name, p_type AS privilege FROM part) g
    JOIN ({CLOSURE_SQL}) c ON g.grantee = c.member OR g.grantee = c.role
    """,
)
def _(t):
    grants = t("part").selectExpr("p_partkey AS grantee", "p_brand AS table_name", "p_type AS privilege")
    return tree.effective_grants(part_edges(t), t("part").select("p_partkey"), grants, paths=False)


@query(
    "subtree_rollup",
    """
    WITH RECURSIVE tree AS (
      SELECT p_partkey AS id, p_partkey AS top FROM part
      UNION ALL SELECT p.p_partkey, tree.top FROM part p JOIN tree ON p.p_partkey // 3 = tree.id AND p.p_partkey > 0)
    SELECT top AS p_partkey, CAST(sum(p_size) AS BIGINT) AS subtree_sum
    FROM tree JOIN part ON p_partkey = id GROUP BY 1
    """,
)
def _(t):
    nodes = t("part").selectExpr("p_partkey", "CASE WHEN p_partkey > 0 THEN p_partkey div 3 END AS parent", "p_size")
    return tree.subtree_rollup(nodes, "p_partkey", "parent", "p_size")


LEVEL_SQL = """CASE WHEN p_partkey >= 2187 THEN 8 WHEN p_partkey >= 729 THEN 7 WHEN p_partkey >= 243 THEN 6
  WHEN p_partkey >= 81 THEN 5 WHEN p_partkey >= 27 THEN 4 WHEN p_partkey >= 9 THEN 3 WHEN p_partkey >= 3 THEN 2
  ELSE 1 END"""
SHORT_SQL = "CASE WHEN p_size < 25 THEN p_type ELSE p_type || '.' || p_brand END"
NODES_SQL = f"""
  SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 3 END AS parent, {LEVEL_SQL} AS level,
    {SHORT_SQL} AS short, p_name AS name FROM part
"""


def ancestors_sql(depth: int) -> str:
    cols = ", ".join(
        f"n{i}.id AS id{i}, n{i}.level AS level{i}, n{i}.name AS name{i}, n{i}.type_name AS type_name{i}"
        for i in range(depth + 1)
    )
    joins = " ".join(f"LEFT JOIN typed n{i} ON n{i}.id = n{i - 1}.parent" for i in range(1, depth + 1))
    return f"""
      WITH nodes AS ({NODES_SQL}),
      types AS (SELECT DISTINCT level, split_part(short, '.', 1) AS type_key, lower(split_part(short, '.', 1)) AS type_name
                FROM nodes WHERE split_part(short, '.', 1) <> 'SMALL'),
      typed AS (SELECT nodes.*, type_name FROM nodes LEFT JOIN types ON types.level = nodes.level
                AND (short = type_key OR split_part(short, '.', 1) = type_key))
      SELECT {cols} FROM typed n0 {joins} WHERE n0.level >= 7
    """


@query("ancestor_flatten", ancestors_sql(5))
def _(t):
    nodes = t("part").selectExpr(
        "p_partkey AS id",
        "CASE WHEN p_partkey > 0 THEN p_partkey div 3 END AS parent",
        f"{LEVEL_SQL} AS level",
        f"{SHORT_SQL} AS short",
        "p_name AS name",
    )
    key = F.split_part("short", F.lit("."), F.lit(1))
    types = nodes.select("level", key.alias("key"), F.lower(key).alias("type_name")).where("key <> 'SMALL'").distinct()
    return tree.ancestor_flatten(nodes, types, 5, 7, carry=["name"])


@query(
    "row_counts_all_tables",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in TABLES),
)
def _(t):
    return quality.row_counts_all_tables({n: t(n) for n in TABLES})


@query(
    "row_counts_from_footers",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in TABLES),
)
def _(t):
    return quality.footer_row_counts(t.spark, {n: f"{t.folder}/{n}.parquet" for n in TABLES})


@query(
    "predicate_counts_all_tables",
    """
    SELECT 'documents' AS table_name, count(*) AS row_count FROM documents WHERE doc_id > 20
    UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id > 20
    """,
)
def _(t):
    return quality.predicate_counts_all_tables({n: t(n) for n in TABLES}, ["doc_id"], lambda: F.col("doc_id") > 20)


def sentinel_sql(columns: list[tuple[str, str]], sentinel: str) -> str:
    counts = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER ({c} = '{sentinel}') AS hits, "
        f"count(*) FILTER ({c} <> '{sentinel}') AS correct FROM {t}"
        for t, c in columns
    )
    return f"""
      SELECT *, hits + correct AS total, round(CAST(hits AS DOUBLE) / nullif(CAST(hits + correct AS DOUBLE), 0), 4) AS error_ratio
      FROM ({counts})
    """


@query("sentinel_ratio", sentinel_sql([("documents", "text"), ("benchmark", "text"), ("conversations", "text")], "ok"))
def _(t):
    return quality.sentinel_ratio({n: t(n) for n in TABLES}, "text", "ok")


TEXT_COLUMNS = [
    ("benchmark", "text"),
    ("conversations", "role"),
    ("conversations", "text"),
    ("customer", "c_name"),
    ("customer", "c_mktsegment"),
    ("documents", "text"),
    ("documents", "lang"),
    ("documents", "source"),
    ("events", "event_type"),
    ("events", "props"),
    ("lineitem", "l_returnflag"),
    ("lineitem", "l_linestatus"),
    ("nation", "n_name"),
    ("orders", "o_orderstatus"),
    ("orders", "o_orderpriority"),
    ("pages", "url"),
    ("pages", "html"),
    ("part", "p_name"),
    ("part", "p_brand"),
    ("part", "p_type"),
    ("region", "r_name"),
    ("supplier", "s_name"),
]


@query("sentinel_scan_all_columns", f"SELECT * FROM ({sentinel_sql(TEXT_COLUMNS, 'F')}) WHERE hits > 0")
def _(t):
    return quality.sentinel_scan_all_columns({n: t(n) for n in TABLES}, "F")


PERIODS_SQL = """
  SELECT event_id, user_id, ts AS lo, CASE WHEN event_id % 50 <> 0 THEN ts + to_seconds(CAST(floor(value * 3600) AS BIGINT)) END AS hi
  FROM events
"""


def event_periods(t):
    seconds = F.floor(F.col("value") * 3600)
    end = F.timestamp_add("SECOND", seconds, F.col("ts"))
    return (
        t("events")
        .select("event_id", "user_id", F.col("ts").alias("lo"), F.when(F.col("event_id") % 50 != 0, end).alias("hi"))
    )


@query(
    "overlapping_periods",
    f"""
    WITH p AS ({PERIODS_SQL})
    SELECT * FROM p a WHERE EXISTS (
      SELECT 1 FROM p b WHERE b.user_id = a.user_id AND b.event_id <> a.event_id
        AND a.lo IS DISTINCT FROM a.hi AND b.lo IS DISTINCT FROM b.hi AND a.lo < coalesce(b.hi, TIMESTAMP '9999-01-01') AND b.lo < coalesce(a.hi, TIMESTAMP '9999-01-01'))
    """,
)
def _(t):
    return win.overlapping_periods(event_periods(t), "user_id", "event_id", "lo", "hi", slices=8)


@query(
    "closed_period_rows",
    f"""
    SELECT *, lo IS DISTINCT FROM lo2 OR hi IS DISTINCT FROM hi2 AS period_differs, lo IS DISTINCT FROM lo2 AS lower_differs
    FROM (SELECT *, CASE WHEN user_id < 20 THEN date_trunc('day', lo) ELSE lo END AS lo2,
            CASE WHEN user_id > 30 THEN hi END AS hi2 FROM ({PERIODS_SQL}))
    WHERE hi IS NOT NULL
    """,
)
def _(t):
    rows = (
        event_periods(t)
        .withColumn("lo2", F.when(F.col("user_id") < 20, F.col("lo").cast("date").cast("timestamp_ntz")).otherwise(F.col("lo")))
        .withColumn("hi2", F.when(F.col("user_id") > 30, F.col("hi")))
    )
    return win.closed_period_rows(rows, "lo", "hi", ("lo2", "hi2"))


@query(
    "fuzzy_pairs",
    """
    WITH n AS (SELECT p_name AS name, count(*) AS rows FROM part GROUP BY 1)
    SELECT a.name AS name_1, b.name AS name_2, CAST(levenshtein(a.name, b.name) AS INTEGER) AS distance,
      a.rows AS rows_1, b.rows AS rows_2
    FROM n a JOIN n b ON levenshtein(a.name, b.name) < 4 AND (a.name <> b.name OR a.rows > 1)
    """,
)
def _(t):
    return matching.fuzzy_pairs(t("part"), "p_partkey", "p_name")


FORMS = ["economy", r"standard\b", "med(?:ium|)", "small part"]
FORM_PATTERN = r"(?i)^\s*(" + "|".join(FORMS) + r")?[\s''\"“”«»’]*(.*?)[\s''\"“”«»’]*$"


@query(
    "name_normalize_legal_form",
    rf"""
    SELECT p_partkey, normalized_name, CAST(NULL AS VARCHAR) AS firm_form,
      regexp_extract(normalized_name, '{FORM_PATTERN}', 2) AS firm_name, count(*) OVER () AS total_count
    FROM (SELECT p_partkey, trim(translate(p_type || ' "' || p_name || '"', 'AO', 'ao')) AS normalized_name FROM part)
    WHERE regexp_extract(normalized_name, '{FORM_PATTERN}', 1) = '' AND normalized_name NOT ILIKE 'PROMO % ring%'
    """,
)
def _(t):
    rows = t("part").select("p_partkey", F.concat("p_type", F.lit(' "'), "p_name", F.lit('"')).alias("full_name"))
    return matching.name_normalize_legal_form(rows, "full_name", FORMS, ("AO", "ao"), ["PROMO % ring%"]).drop("full_name")
