"""Small inputs with results known by hand."""

import pytest
from pyspark.sql import functions as F

from tablewright.functions import lsn, predicates, text, variants, versions
from tablewright.operators import aggregates, arrays, hierarchy, histograms, json_tables, windows
from tablewright.operators.xml_tables import XmlColumn, xml_table


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_version_compare(spark):
    # The first seven pairs have recorded verdicts.
    data = [
        ("0.5.5", "0.5.11", -1),
        ("0.5.11", "0.5.16", -1),
        ("0.6.1", "0.5.16", 1),
        ("0.5.11", "0.18.99", -1),
        ("0.7.28", "0.7.28-release", -1),
        ("0.7.28release", "0.7.28-release", 0),
        ("0.7.28тест", "0.7.28-release", 1),
        ("1.2.3.4.5.6", "1.2.3.4.5.7", 0),
        (None, "1", None),
    ]
    df = spark.createDataFrame(data, "a string, b string, want int")
    got = df.withColumn("got", versions.version_compare("a", "b")).withColumn("back", versions.version_compare("b", "a"))
    for r in got.collect():
        assert r["got"] == r["want"]
        assert r["back"] == (None if r["want"] is None else -r["want"])
    parts = df.select(versions.version_split("a").alias("t"), versions.version_split("a", as_int=True).alias("n")).collect()
    assert parts[5]["t"] == ["0", "7", "28", "release"] and parts[5]["n"] == [0, 7, None]
    assert one(spark, versions.version_verdict(versions.version_compare(F.lit("1.2"), F.lit("1.10")))) == "ver1 < ver2"


def test_calendar_histogram(spark):
    # Dates with a recorded histogram.
    days = (
        "2019-01-01 2020-01-01 2020-01-03 2020-02-01 2020-03-01 2020-06-01 2020-08-01 2020-08-10 2021-01-01 2021-01-01 "
        "2021-08-01 2021-09-10 2021-09-20 2021-10-01 2021-11-01 2021-12-10 2021-12-20"
    ).split()
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date"))
    got = histograms.calendar_histogram(df, "d", "6 months").collect()
    assert [(r["bucket"], r["cnt"], str(r["range_lower"])[:10], r["range_upper"] and str(r["range_upper"])[:10]) for r in got] == [
        (1, 1, "2019-01-01", "2019-07-01"),
        (3, 5, "2020-01-01", "2020-07-01"),
        (4, 2, "2020-07-01", "2021-01-01"),
        (5, 2, "2021-01-01", "2021-07-01"),
        (6, 7, "2021-07-01", None),
    ]
    assert [len(r["bar_percent"]) for r in got] == [6, 29, 12, 12, 41]
    assert got[1]["bar"] == "■" * 5 and got[0]["total_count"] == 17
    plain = histograms.equi_width_histogram(df, "d", 5)
    assert sum(r["cnt"] for r in plain.collect()) == 17
    assert [r["bucket"] for r in plain.orderBy("bucket").collect()][-1] == 6


@pytest.mark.parametrize("step", ["1 month", "10 days", "7 hours", "3 months", "1 year"])
def test_boundary_bucket_matches_a_list_of_bounds(spark, step):
    df = spark.range(400).select(F.timestamp_add("HOUR", F.col("id") * 37, F.lit("2019-01-28 05:00:00").cast("timestamp_ntz")).alias("d"))
    got = histograms.boundary_bucket(df, "d", step)
    bounds = df.agg(F.expr(f"sequence(min(d), max(d), interval {step})").alias("b"))
    want = df.crossJoin(bounds).select("d", F.size(F.filter("b", lambda x: x <= F.col("d"))).cast("bigint"))
    assert rows(got.select("d", "bucket"), "d") == rows(want, "d")


def test_array_sum(spark):
    data = [([4, 0],), ([10, 20, 30],), ([-1, 1, 1, 2, 5],), ([],), ([None, 7],), (None,)]
    df = spark.createDataFrame(data, "arr array<int>")
    assert arrays.array_column_sum(df, "arr").first()["sums"] == [13, 28, 31, 2, 5]
    assert [r["sum_elem"] for r in arrays.array_column_sum(df, "arr", as_array=False).collect()] == [13, 28, 31, 2, 5]
    assert arrays.array_explode_ordinal(df, "arr").count() == 12


DEPOT = """<depot>
 <bay code="n"><title>North</title><crates>
   <crate no="7"><kilo>40</kilo><note>fragile</note></crate>
   <crate no="9"><kilo>15</kilo></crate></crates></bay>
 <bay code="s"><title>Süd</title><crates><crate no="7"><kilo>8</kilo></crate></crates><keeper><title>Jo</title></keeper></bay>
 <bay code="x"><title>Spare</title></bay></depot>"""


def test_xml_table(spark):
    df = spark.createDataFrame([(7, DEPOT)], "doc int, xml string")
    columns = [
        XmlColumn("id", ordinality=True),
        XmlColumn("bay", path="../../title", not_null=True),
        XmlColumn("no", "int", "@no", not_null=True),
        XmlColumn("kilo", "int"),
        XmlColumn("note", path="note", default="none given"),
    ]
    got = rows(xml_table(df, "xml", "/depot/bay/crates/crate", columns), "id")
    assert got == [
        (7, 1, "North", 7, 40, "fragile"),
        (7, 2, "North", 9, 15, "none given"),
        (7, 3, "Süd", 7, 8, "none given"),
    ]
    strict = [XmlColumn("note", not_null=True)]
    with pytest.raises(Exception, match="null in column note"):
        xml_table(df, "xml", "/depot/bay/crates/crate", strict).collect()
    assert one(spark, variants.xpath_scalar(F.lit(DEPOT), "count(//crate)", "int")) == 3


ROLE_EDGES = [("ann", "dev"), ("ann", "ops"), ("dev", "staff"), ("ops", "staff"), ("staff", "all")]


def test_roles_and_grants(spark):
    """Two ways lead to one role, and each is a row."""
    edges = spark.createDataFrame(ROLE_EDGES, "member string, role string")
    nodes = spark.createDataFrame([(n,) for n in ("ann", "bob", "dev", "ops", "staff", "all")], "name string")
    got = {(r["member"], r["role"], r["path"]) for r in hierarchy.membership_closure(edges, "member", "role", nodes).collect()}
    paths = [
        ("ann", "dev"), ("ann", "ops"), ("ann", "dev", "staff"), ("ann", "ops", "staff"), ("ann", "dev", "staff", "all"),
        ("ann", "ops", "staff", "all"), ("dev", "staff"), ("dev", "staff", "all"), ("ops", "staff"), ("ops", "staff", "all"),
        ("staff", "all"),
    ]
    assert got == {(p[0], p[-1], " ➫ ".join(p)) for p in paths} | {("bob", None, ""), ("all", None, "")}
    grants = spark.createDataFrame(
        [("ann", "t1", "SELECT"), ("bob", "t1", "SELECT"), ("staff", "t2", "SELECT")], "grantee string, table_name string, privilege string"
    )
    counted = hierarchy.effective_grants(edges, nodes, grants).groupBy("grantee").count()
    assert {tuple(r) for r in counted.collect()} == {("ann", 6), ("bob", 1), ("staff", 5)}


def test_closure_stops_at_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "m string, r string")
    got = {(r["member"], r["role"]) for r in hierarchy.membership_closure(edges, "m", "r").collect()}
    assert got == {(x, y) for x in "abc" for y in "abc" if x != y}


def test_long_chains(spark):
    chain = spark.range(70).select(F.col("id").alias("m"), (F.col("id") + 1).alias("r"))
    assert hierarchy.membership_closure(chain, "m", "r").count() == 70 * 71 // 2
    path = spark.range(70).select("id", F.nullif(F.col("id") - 1, F.lit(-1)).alias("parent"), F.lit(1).alias("v"))
    sums = {r["id"]: r["subtree_sum"] for r in hierarchy.subtree_rollup(path, "id", "parent", "v").collect()}
    assert sums == {i: 70 - i for i in range(70)}


def test_subtree_rollup(spark):
    nodes = spark.createDataFrame([(1, None, 1), (2, 1, 10), (3, 1, 100), (4, 2, 1000), (5, 99, 7)], "id int, parent int, v int")
    assert rows(hierarchy.subtree_rollup(nodes, "id", "parent", "v"), "id") == [(1, 1111), (2, 1010), (3, 100), (4, 1000), (5, 7)]
    loop = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, 1, 1)], "id int, parent int, v int")
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.subtree_rollup(loop, "id", "parent", "v")


ONE = [
    (10, "pump", 4, '{"kind": "a", "parts": [{"p": 1}, {"p": 2}]}'),
    (20, "valve", 5, '{"kind": "b", "parts": [{"p": 3, "q": "x"}], "meta": {"w": 1}}'),
    (30, "gauge", 6, '{"kind": "c"}'),
]
TWO = [
    (10, "pump", 9, ONE[0][3]),
    (20, "valve", 5, '{"kind": "b", "parts": [{"p": 3, "q": "y"}], "meta": {"w": 2}}'),
    (30, "dial", 6, '{"kind": "d"}'),
    (40, "hose", 1, "{}"),
]
SCHEMA = "id int, label string, amount int, body string"
DEEP = {
    (10, ".amount"),
    (20, ".body"),
    (20, ".body.meta"),
    (20, ".body.meta.w"),
    (20, ".body.parts"),
    (20, ".body.parts[0]"),
    (20, ".body.parts[0].q"),
    (30, ".body"),
    (30, ".body.kind"),
    (30, ".label"),
}


def test_table_diffs(spark):
    one_df, two_df = spark.createDataFrame(ONE, SCHEMA), spark.createDataFrame(TWO, SCHEMA)
    shallow = dict(rows(json_tables.table_diff_shallow(one_df, two_df, "id", ["body"])))
    assert shallow == {10: '{"amount":{"old":9,"new":4}}', 30: '{"label":{"old":"dial","new":"gauge"}}'}
    deep = json_tables.table_diff_deep(one_df, two_df, "id", json_cols=["body"])
    assert {(r["id"], r["change_path"]) for r in deep.collect()} == DEEP
    inner = deep.where("change_path = '.body.parts[0].q'").first()
    assert (inner["one_value"], inner["two_value"]) == ("x", "y")
    back = json_tables.table_diff_deep(two_df, one_df, "id", json_cols=["body"])
    swapped = back.select("id", "change_path", F.col("two_value").alias("a"), F.col("one_value").alias("b"))
    assert sorted(rows(swapped)) == sorted(rows(deep))
    assert json_tables.table_diff_deep(one_df, one_df, "id", json_cols=["body"]).isEmpty()
    limited = json_tables.table_diff_deep_limited(one_df, two_df, "id", json_cols=["body"])
    assert {(r["id"], r["change_path"]) for r in limited.collect()} == DEEP | {(40, "<one row missing>")}
    ignored = json_tables.table_diff_deep_limited(
        one_df, two_df, "id", [".label", ".body.kind", ".body.parts"], json_cols=["body"]
    )
    left = {(10, ".amount"), (20, ".body"), (20, ".body.meta"), (20, ".body.meta.w"), (40, "<one row missing>")}
    assert {(r["id"], r["change_path"]) for r in ignored.collect()} == left
    first = json_tables.table_diff_deep_limited(one_df, two_df, "id", limit=1, json_cols=["body"])
    assert {(r["id"], r["change_path"]) for r in first.collect()} == {(10, ".amount"), (40, "<one row missing>")}


def test_diff_ignores_null_values_and_one_sided_paths(spark):
    a = spark.createDataFrame([(1, '{"x": null, "y": 1, "only": 2, "z": [1, 2, 3]}')], "id int, j string")
    b = spark.createDataFrame([(1, '{"x": 5, "y": "1", "z": [1, 9]}')], "id int, j string")
    got = {r["change_path"] for r in json_tables.table_diff_deep(a, b, "id", json_cols=["j"]).collect()}
    assert got == {".j", ".j.z", ".j.z[1]"}


def test_json_paths(spark):
    doc = '{"s": [[1, {"t": null}], "u"], "v": {"w": {"x": false}}, "y": -2.5}'
    df = spark.createDataFrame([(1, doc)], "id int, j string")
    got = {(r["path"], r["value"], r["type"]) for r in json_tables.json_path_flatten(df, "id", "j").collect()}
    assert got == {
        (".s", '[[1,{"t":null}],"u"]', "array"),
        (".s[0]", '[1,{"t":null}]', "array"),
        (".s[0][0]", "1", "number"),
        (".s[0][1]", '{"t":null}', "object"),
        (".s[0][1].t", None, "null"),
        (".s[1]", "u", "string"),
        (".v", '{"w":{"x":false}}', "object"),
        (".v.w", '{"x":false}', "object"),
        (".v.w.x", "false", "boolean"),
        (".y", "-2.5", "number"),
    }
    odd = spark.createDataFrame([(1, '{"a.b": 1, "a": {"b": 1}}')], "id int, j string")
    assert [r["path"] for r in json_tables.json_path_flatten(odd, "id", "j").orderBy("path").collect()] == [".a", ".a.b"]


def test_json_edits(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, 2]}, "c": null}')], "id int, j string")
    edit = json_tables.json_set_merge_delete
    assert edit(df, "j", set={".a.b[1]": F.lit("x")}).first()["j"] == '{"a":{"b":[1,"x"]},"c":null}'
    assert edit(df, "j", set={".d": F.lit(True), ".e.f": F.lit(1)}).first()["j"] == '{"a":{"b":[1,2]},"c":null,"d":true}'
    assert edit(df, "j", merge='{"a": 1, "z": [0]}').first()["j"] == '{"a":1,"c":null,"z":[0]}'
    assert edit(df, "j", drop=[".a.b[0]", ".c", ".missing"]).first()["j"] == '{"a":{"b":[2]}}'
    assert one(spark, variants.json_get(F.lit('{"a": ["x", null]}'), ".a[1]")) is None
    assert one(spark, variants.json_get(F.lit('{"a": ["x", null]}'), ".a[1]", as_text=False)) == "null"
    assert one(spark, variants.json_get(F.lit('{"a": ["x"]}'), ".a[0]", as_text=False)) == '"x"'


@pytest.mark.parametrize(
    "ms, want",
    [
        (12345678, "03:25:45.678"),  # fixed value
        (0, "00:00:00.000"),
        (86_400_000, "24:00:00.000"),
        (360_000_000, "100:00:00.000"),
        (3_600_000_000_000, "1000000:00:00.000"),
        (-1, "-00:00:00.001"),
        (None, None),
    ],
)
def test_format_interval(spark, ms, want):
    assert one(spark, text.format_interval(F.lit(ms).cast("bigint"))) == want


def test_interval_between_timestamps(spark):
    start, end = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-01 00:00:00", "2024-01-02 00:00:00.5"))
    assert one(spark, text.format_interval(start, end)) == "24:00:00.500"


@pytest.mark.parametrize("size, want", [(0, "0.00 B"), (1023, "1023.00 B"), (1536, "1.50 KiB"), (1 << 30, "1.00 GiB"), (1 << 61, "2.00 EiB"), (None, None)])
def test_readable_size(spark, size, want):
    assert one(spark, text.readable_size(F.lit(size).cast("bigint"))) == want


def test_template(spark):
    values = {"msg": F.lit("done ${cur_time}"), "cur_time": F.lit("12:00")}
    assert one(spark, text.template_render("[${cur_time}] 5% ${msg} ${other}", values)) == "[12:00] 5%% done ${cur_time} ${other}"
    assert one(spark, text.template_render("${msg}", {"msg": F.lit(None).cast("string")})) is None


def test_try_cast(spark):
    def cast(value, kind, default=None):
        return one(spark, predicates.try_cast_default(F.lit(value).cast("string"), kind, default))

    assert cast("foo", "string") == "foo"
    assert cast("2018-01-41", "date") is None
    assert str(cast("2018-01-41", "date", "2020-02-02")) == "2020-02-02"
    assert cast(None, "int", 5) is None
    assert cast("12", "int", 5) == 12


def test_lsn_forms(spark):
    # Both forms of two log positions.
    pairs = [("0000001e:00000038:0001", "30000000005600001"), ("000a4444:fdae4f71:13361", "672836425605924978689")]
    for shown, dec in pairs:
        assert one(spark, lsn.lsn_convert(F.lit(shown), "text", "dec")) == dec
        assert one(spark, lsn.lsn_convert(F.lit(dec), "dec", "text")) == shown
        for form in ("hex", "binary"):
            assert one(spark, lsn.lsn_convert(lsn.lsn_convert(F.lit(shown), "text", form), form, "text")) == shown
        assert one(spark, lsn.lsn_check(F.lit(shown))) == "CORRECT"
    assert one(spark, lsn.lsn_convert(F.lit(pairs[0][0]), "text", "hex")) == "0x0000001e0000003800000001"
    assert one(spark, lsn.lsn_check(F.lit("0000001e:00000038:fffff"))) == "Error"
    df = spark.createDataFrame([(p[0],) for p in pairs], "lsn string")
    assert [r["lsn_check"] for r in lsn.lsn_normalize(df, "lsn").collect()] == ["CORRECT", "CORRECT"]


def test_tokens(spark):
    df = spark.createDataFrame([(1, "a fat cat sat on a mat and ate a fat rat"), (2, "  "), (3, "Ёлка, ёлка; A-b b")], "id int, t string")
    plain = dict(rows(arrays.tsvector_tokens(df, "id", "t", positions=False)))
    assert plain[1] == ["a", "and", "ate", "cat", "fat", "mat", "on", "rat", "sat"] and plain[2] == []
    placed = {(r["id"], r["lexeme"]): r["positions"] for r in arrays.tsvector_tokens(df, "id", "t", ["and", "on"]).collect()}
    assert placed[1, "a"] == [1, 6, 10] and placed[1, "rat"] == [12] and (1, "on") not in placed
    assert placed[3, "ёлка"] == [1, 2] and placed[3, "b"] == [4, 5] and not [k for k in placed if k[0] == 2]


def test_row_hash_tells_null_places_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("", "a")], "x string, y string")
    for method in ("md5", "xxhash64"):
        assert arrays.row_hash(df, method=method).select("row_hash").distinct().count() == 3


def test_query_to_json_parts_and_empty(spark):
    df = spark.range(25).select((F.col("id") % 2).alias("g"), "id", F.nullif(F.col("id"), F.lit(4)).alias("v"))
    got = rows(aggregates.query_to_json(df.where("id < 6"), "g", ["id"], 100, strip_nulls=True), "g")
    assert got[0] == (0, 0, '[{"id":0,"v":0},{"id":2,"v":2},{"id":4}]')
    parts = aggregates.query_to_json(df, None, ["id"], rows_per_part=10, slices=3)
    assert [r["part"] for r in parts.orderBy("part").collect()] == [0, 1, 2]
    assert rows(aggregates.query_to_json(df.where("id < 0"), None, ["id"], 100)) == [(None, None)]


def test_rows_per_char(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 5, 0).otherwise(9).alias("x"))
    got = {r["cnt"]: len(r["bar"]) for r in histograms.equi_width_histogram(df, "x", 3, rows_per_char=5).collect()}
    assert got == {995: 199, 5: 1}


@pytest.mark.parametrize("low", ["2019-01-29", "2019-01-30", "2019-01-31", "2020-02-29", "2019-08-31 13:05:01", "2020-01-30"])
@pytest.mark.parametrize("months", [1, 2, 5, 12, 48])
def test_month_ends(spark, low, months):
    """Boundaries follow from one another, as a series of SQL does."""
    import duckdb

    df = spark.sql(f"SELECT timestamp_ntz '{low}' AS d UNION ALL SELECT timestampadd(HOUR, id * 41, timestamp_ntz '{low}') FROM range(1, 1800)")
    got = sorted(tuple(r) for r in histograms.boundary_bucket(df, "d", f"{months} months").collect())
    con = duckdb.connect()
    con.register("t", df.toPandas())
    want = con.sql(f"""
        WITH b AS (SELECT generate_series(min(d), max(d), INTERVAL {months} MONTH) AS bounds FROM t),
        n AS (SELECT d, bounds, len([x for x in bounds if x <= d]) AS k FROM t, b)
        SELECT d, k, bounds[k], CASE WHEN k < len(bounds) THEN bounds[k + 1] END FROM n""").fetchall()
    assert got == sorted(want)


def test_overlaps_in_the_type_of_the_column(spark):
    cases = {
        "timestamp_ntz": [("9999-12-31 11:00:00", None), ("9999-12-31 12:00:00", None), ("9999-12-31 13:00:00", "9999-12-31 13:00:00")],
        "date": [("9999-12-31", None), ("2024-01-01", "2024-01-02"), (None, None)],
        "bigint": [("9223372036854775807", None), ("9223372036854775806", None), (None, "-9223372036854775808")],
        "decimal(20,0)": [("9007199254740992", "9007199254740993"), ("9007199254740992", "9007199254740993"), ("9007199254740993", "9007199254740994")],
    }
    expected = {"timestamp_ntz": {0, 1}, "date": {0, 1, 2}, "bigint": {0, 1}, "decimal(20,0)": {0, 1}}
    for kind, periods in cases.items():
        rows_in = [(1, i, a, b) for i, (a, b) in enumerate(periods)]
        df = spark.createDataFrame(rows_in, "k int, id int, a string, b string")
        df = df.select("k", "id", F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))
        for slices in (1, 3):
            got = windows.overlapping_periods(df, "k", "id", "a", "b", slices=slices)
            assert {r["id"] for r in got.collect()} == expected[kind], kind


def test_list_bucket(spark):
    df = spark.createDataFrame([(1,), (5,), (6,), (None,)], "x int")
    assert rows(histograms.list_bucket(df, "x", [6, 2])) == [(1, 0), (5, 1), (6, 2), (None, None)]
