"""JSON and XML documents built from orders and their lines, and table diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.variants import json_get, json_has_key, json_type, xpath_scalar
from tablewright.operators import json_tables as jt
from tablewright.operators.arrays import row_to_json
from tablewright.operators.xml_tables import XmlColumn, xml_table
from tablewright.plans.registry import query
from tablewright.session import cut_lineage

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)

# The changed copy: cheap orders change status, dear ones the quantity of their first lines.
STATUS_SQL = "CASE WHEN o_totalprice < 50000 THEN 'X' ELSE o_orderstatus END"
BONUS_SQL = "CASE WHEN o_totalprice > 300000 AND l_linenumber = 1 THEN 1 ELSE 0 END"
IN_ONE_SQL = "o_totalprice NOT BETWEEN 102000 AND 103000"
IN_TWO_SQL = "o_totalprice NOT BETWEEN 100000 AND 101000"


def docs_sql(status: str = "o_orderstatus", bonus: str = "0", where: str = "true") -> str:
    return f"""
      SELECT o_orderkey, to_json({{'id': o_orderkey, 'lines': list({{'part': l_partkey,
          'qty': CAST(l_quantity AS INTEGER) + {bonus}}} ORDER BY {LINE_ORDER_SQL}), 'status': any_value({status})}}) AS doc
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {where} GROUP BY o_orderkey
    """


def order_documents(t, status="o_orderstatus", bonus="0", where="true"):
    """One JSON document per order: id, lines and status."""
    orders = t("orders").where(where).select("o_orderkey", "o_totalprice", F.expr(status).alias("status"))
    joined = orders.join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    line = F.struct(
        *LINE_ORDER, F.col("l_partkey").alias("part"), (F.col("l_quantity").cast("int") + F.expr(bonus)).alias("qty")
    )
    grouped = joined.groupBy("o_orderkey", "status").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    lines = F.transform("lines", lambda x: F.struct(x["part"].alias("part"), x["qty"].alias("qty")))
    doc = F.struct(F.col("o_orderkey").alias("id"), lines.alias("lines"), "status")
    return grouped.select("o_orderkey", F.to_json(doc).alias("doc"))


TYPE_SQL = """CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string'
  WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"""


def tree_sql(rows: str, key: str, doc: str) -> str:
    return f"""
      SELECT r.{key}, substr(j.fullkey, 2) AS path, j.value ->> '$' AS value, {TYPE_SQL.replace('type', 'j.type', 1)} AS type
      FROM ({rows}) r, json_tree(r.{doc}) j WHERE j.fullkey <> '$'
    """


@query("json_path_flatten", tree_sql(docs_sql(), "o_orderkey", "doc"))
def _(t):
    return jt.json_path_flatten(cut_lineage(order_documents(t)), "o_orderkey", "doc")


@query(
    "row_to_json",
    """
    SELECT to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey, 'segment':
      nullif(c_mktsegment, 'BUILDING')})::VARCHAR AS row_json FROM customer
    """,
)
def _(t):
    rows = t("customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment")
    )
    return row_to_json(rows, drop=["c_acctbal"])


@query(
    "json_set_merge_delete",
    f"""
    SELECT o_orderkey, to_json({{'id': o_orderkey, 'lines': list(
        CASE WHEN n = 1 THEN 99 ELSE CAST(l_quantity AS INTEGER) END ORDER BY n)}})::VARCHAR AS doc_short,
      to_json({{'first': any_value(o_orderkey * 2), 'id': o_orderkey, 'source': 'copy'}})::VARCHAR AS doc_flat
    FROM (
      SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY {LINE_ORDER_SQL}) AS n
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
    GROUP BY o_orderkey
    """,
)
def _(t):
    docs = order_documents(t)
    edited = jt.json_set_merge_delete(docs, "doc", set={".lines[0].qty": F.lit(99)}, drop=[".status"])
    flat = jt.json_set_merge_delete(
        docs.withColumnRenamed("doc", "doc_flat"),
        "doc_flat",
        set={".first": F.col("o_orderkey") * 2},
        merge='{"source": "copy", "status": "X"}',
        drop=[".lines", ".status"],
    )
    # Quantities alone, to compare the edited list with the plain rows.
    quantities = F.transform(
        F.expr("cast(parse_json(doc):lines as array<struct<part: bigint, qty: int>>)"), lambda x: x["qty"]
    )
    short = edited.select(
        "o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("id"), quantities.alias("lines"))).alias("doc_short")
    )
    return short.join(flat, "o_orderkey")


@query(
    "json_get",
    f"""
    SELECT o_orderkey, doc ->> '$.status' AS status, CAST(doc -> '$.status' AS VARCHAR) AS status_json,
      doc ->> '$.lines[1].part' AS second_part, 'array' AS lines_type, true AS has_id, false AS has_other
    FROM ({docs_sql()})
    """,
)
def _(t):
    return order_documents(t).select(
        "o_orderkey",
        json_get("doc", ".status").alias("status"),
        json_get("doc", ".status", as_text=False).alias("status_json"),
        json_get("doc", ".lines[1].part").alias("second_part"),
        json_type(F.variant_get(F.parse_json("doc"), "$.lines", "variant")).alias("lines_type"),
        json_has_key("doc", "id").alias("has_id"),
        json_has_key("doc", "other").alias("has_other"),
    )


COPY_SQL = """
  SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal,
    CASE WHEN c_acctbal > 8000 THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment
  FROM customer WHERE c_acctbal > -900
"""


def customer_copy(t):
    return t("customer").where("c_acctbal > -900").selectExpr(
        "c_custkey",
        "c_name",
        "c_nationkey",
        "CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal",
        "CASE WHEN c_acctbal > 8000 THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment",
    )


def shallow_sql(cols: list[str]) -> str:
    pieces = ", ".join(
        f"""CASE WHEN o.{c} IS DISTINCT FROM w.{c} THEN
          '"{c}":' || to_json({{'old': w.{c}, 'new': o.{c}}})::VARCHAR END"""
        for c in cols
    )
    return f"""
      SELECT c_custkey, '{{' || diff || '}}' AS data_diff FROM (
        SELECT o.c_custkey, concat_ws(',', {pieces}) AS diff FROM customer o JOIN ({COPY_SQL}) w ON w.c_custkey = o.c_custkey)
      WHERE diff <> ''
    """


@query("table_diff_shallow", shallow_sql(["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]))
def _(t):
    return jt.table_diff_shallow(t("customer"), customer_copy(t), "c_custkey")


@query("table_diff_lateral", shallow_sql(["c_name", "c_nationkey", "c_mktsegment"]))
def _(t):
    return jt.table_diff_lateral(t("customer"), customer_copy(t), "c_custkey", ignore=["c_acctbal"])


def row_doc_sql(docs: str) -> str:
    return f"SELECT o_orderkey, to_json({{'doc': doc, 'o_orderkey': o_orderkey}}) AS d FROM ({docs})"


def two_sides(t):
    return (
        order_documents(t, where=IN_ONE_SQL),
        order_documents(t, STATUS_SQL, BONUS_SQL, IN_TWO_SQL),
    )


ONE_SQL = row_doc_sql(docs_sql(where=IN_ONE_SQL))
TWO_SQL = row_doc_sql(docs_sql(STATUS_SQL, BONUS_SQL, IN_TWO_SQL))
DEEP_SQL = f"""
  SELECT a.o_orderkey, a.path AS change_path, a.value AS one_value, b.value AS two_value
  FROM ({tree_sql(ONE_SQL, 'o_orderkey', 'd')}) a JOIN ({tree_sql(TWO_SQL, 'o_orderkey', 'd')}) b
    ON a.o_orderkey = b.o_orderkey AND a.path = b.path
  WHERE a.value <> b.value
"""


@query("table_diff_deep", f"SELECT * FROM ({DEEP_SQL}) WHERE change_path <> '.doc'")
def _(t):
    one, two = (cut_lineage(side) for side in two_sides(t))
    return jt.table_diff_deep(one, two, "o_orderkey", [".doc"], json_cols=["doc"])


@query(
    "table_diff_deep_limited",
    f"""
    WITH one AS ({ONE_SQL}), two AS ({TWO_SQL})
    SELECT * FROM ({DEEP_SQL}) WHERE o_orderkey IN (
      SELECT o_orderkey FROM one JOIN two USING (o_orderkey) WHERE one.d::VARCHAR <> two.d::VARCHAR
      ORDER BY o_orderkey LIMIT 100)
    UNION ALL SELECT o_orderkey, '<two row missing>', d::VARCHAR, NULL FROM one
      WHERE o_orderkey NOT IN (SELECT o_orderkey FROM two)
    UNION ALL SELECT o_orderkey, '<one row missing>', NULL, d::VARCHAR FROM two
      WHERE o_orderkey NOT IN (SELECT o_orderkey FROM one)
    """,
)
def _(t):
    # Built documents stand in for stored tables: the diff reads each side more than once.
    one, two = (cut_lineage(side) for side in two_sides(t))
    return jt.table_diff_deep_limited(one, two, "o_orderkey", json_cols=["doc"])


@query(
    "diff_key_uniqueness",
    """
    SELECT 'one' AS side, o_custkey AS key, count(*) AS cnt FROM orders GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'two', l_orderkey, count(*) FROM lineitem GROUP BY 2 HAVING count(*) > 1
    """,
)
def _(t):
    return jt.diff_key_uniqueness(
        t("orders").select(F.col("o_custkey").alias("k")), t("lineitem").select(F.col("l_orderkey").alias("k")), "k"
    )


@query(
    "diff_row_counts",
    f"""
    SELECT (SELECT count(*) FROM customer) AS rows_in_one, (SELECT count(*) FROM ({COPY_SQL})) AS rows_in_two,
      (SELECT count(*) FROM customer o JOIN ({COPY_SQL}) w ON o.c_custkey = w.c_custkey
       WHERE o.c_acctbal IS DISTINCT FROM w.c_acctbal OR o.c_mktsegment IS DISTINCT FROM w.c_mktsegment) AS differed_rows
    """,
)
def _(t):
    return jt.diff_row_counts(t("customer"), customer_copy(t), "c_custkey")


def order_xml(t):
    """One XML document per order; only lines of more than 25 pieces have a comment."""
    lines = t("lineitem").withColumn(
        "_xml",
        F.concat(
            F.format_string('<line no="%d"><part>%d</part><qty>%d</qty>', "l_linenumber", "l_partkey", F.col("l_quantity").cast("int")),
            F.when(F.col("l_quantity") > 25, F.format_string("<comment>large &amp; %s</comment>", "l_returnflag")).otherwise(""),
            F.lit("</line>"),
        ),
    )
    per_order = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*LINE_ORDER, "_xml"))).alias("_lines"))
    body = F.array_join(F.transform("_lines", lambda x: x["_xml"]), "")
    return (
        t("orders")
        .join(per_order, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "o_orderkey",
            F.concat(
                F.format_string('<order id="%d"><status>%s</status><lines>', "o_orderkey", "o_orderstatus"),
                body,
                F.lit("</lines></order>"),
            ).alias("xml"),
        )
    )


@query(
    "xml_table",
    f"""
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY {LINE_ORDER_SQL}) AS id,
      o_orderstatus AS status, o_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part,
      CAST(l_quantity AS INTEGER) AS qty,
      CASE WHEN l_quantity > 25 THEN 'large & ' || l_returnflag ELSE 'A regular line' END AS comment
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    """,
)
def _(t):
    return xml_table(
        order_xml(t),
        "xml",
        "/order/lines/line",
        [
            XmlColumn("id", ordinality=True),
            XmlColumn("status", path="../../status", not_null=True),
            XmlColumn("order_id", "bigint", "../../@id", not_null=True),
            XmlColumn("line_no", "int", "@no", not_null=True),
            XmlColumn("part", "bigint"),
            XmlColumn("qty", "int"),
            XmlColumn("comment", default="A regular line"),
        ],
    )


@query(
    "xpath_scalar",
    """
    SELECT o_orderkey, o_orderkey AS id, any_value(o_orderstatus) AS status, CAST(count(*) AS INTEGER) AS lines,
      CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS quantity
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
    """,
)
def _(t):
    return order_xml(t).select(
        "o_orderkey",
        xpath_scalar("xml", "/order/@id", "bigint").alias("id"),
        xpath_scalar("xml", "/order/status").alias("status"),
        xpath_scalar("xml", "count(/order/lines/line)", "int").alias("lines"),
        xpath_scalar("xml", "sum(/order/lines/line/qty)", "bigint").alias("quantity"),
    )
