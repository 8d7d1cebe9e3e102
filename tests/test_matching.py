"""Near names against comparing everything with everything."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import matching
from tablewright.operators.matching import fuzzy_pairs, name_normalize_legal_form


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, start=1):
        row, above = [i], row
        for j, y in enumerate(b, start=1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def names(seed):
    """Words of every length, near copies, and a hot prefix that two thirds of the names share."""
    rng = random.Random(seed)
    out = ["", "a", "ab", "abc", "abcd", "abcde", "abcdef", "zz", "|0|", "a|1|b"]
    for _ in range(25):
        base = "".join(rng.choice("abc|") for _ in range(rng.randrange(1, 14)))
        out += [base, base[1:], base[:-2] + "c", base + "ab"]
    for _ in range(120):
        tail = "".join(rng.choice("xyz") for _ in range(rng.randrange(4, 9)))
        out.append("common prefix " + tail)
    return out


@pytest.mark.parametrize("hot_block, limit", [(1000, 3), (5, 3), (5, 1)])
def test_fuzzy_pairs_equal_brute_force(spark, hot_block, limit):
    data = names(hot_block)
    df = spark.createDataFrame([(i, n) for i, n in enumerate(data)], "id int, name string").repartition(3)
    got = fuzzy_pairs(df, "id", "name", max_distance=limit, hot_block=hot_block).collect()
    distinct = sorted(set(data))
    want = {(a, b, distance(a, b)) for a in distinct for b in distinct if a != b and distance(a, b) <= limit}
    want |= {(a, a, 0) for a in distinct if data.count(a) > 1}
    assert len(got) == len(want)
    assert {(r["name_1"], r["name_2"], r["distance"]) for r in got} == want
    for r in got:
        assert (r["rows_1"], r["rows_2"]) == (data.count(r["name_1"]), data.count(r["name_2"]))


@pytest.mark.parametrize("rounds", [1, 2])
def test_blocks_that_stay_large_are_dealt_out(spark, monkeypatch, rounds):
    """Names that share a long stretch, after the last round: no group is larger than a cell, no pair is lost."""
    rng = random.Random(rounds)
    data = ["the common stretch of all these names " + "".join(rng.choice("uvwxyz") for _ in range(8)) for _ in range(400)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(data)], "id int, name string")
    monkeypatch.setattr(matching, "_MAX_ROUNDS", rounds)
    groups, plain = [], matching._verified

    def watched(index, probes, on, distance):
        groups.extend(side.groupBy(*on).count().agg(F.max("count")).first()[0] or 0 for side in (index, probes) if "block" in on)
        return plain(index, probes, on, distance)

    monkeypatch.setattr(matching, "_verified", watched)
    got = fuzzy_pairs(df, "id", "name", hot_block=60).collect()
    want = {(a, b) for a in set(data) for b in set(data) if a != b and distance(a[-8:], b[-8:]) <= 3}
    assert {(r["name_1"], r["name_2"]) for r in got if r["distance"]} == want
    assert 30 < max(groups) <= 120


def test_fuzzy_pairs_compare_a_prefix(spark):
    df = spark.createDataFrame([(1, "abcdefgh-long tail"), (2, "abcdefgx-other ending"), (3, None)], "id int, name string")
    got = fuzzy_pairs(df, "id", "name", prefix=8).collect()
    assert {(r["name_1"], r["name_2"], r["distance"]) for r in got} == {("abcdefgh", "abcdefgx", 1), ("abcdefgx", "abcdefgh", 1)}


def test_legal_forms(spark):
    rows = [(1, 'LTD "Blue Heron"'), (2, "Quarry Works"), (3, "Council of Elm district"), (4, " ltd  Fír ")]
    df = spark.createDataFrame(rows, "id int, name string")
    forms, mapping = ["LTD", "LLC"], ("íÍ", "iI")
    got = {r["id"]: r for r in name_normalize_legal_form(df, "name", forms, mapping, only_without_form=False).collect()}
    assert (got[1]["firm_form"], got[1]["firm_name"]) == ("LTD", "Blue Heron")
    assert (got[2]["firm_form"], got[2]["firm_name"]) == (None, "Quarry Works")
    left = name_normalize_legal_form(df, "name", forms, mapping, ["Council % district%"]).collect()
    assert [(r["id"], r["total_count"]) for r in left] == [(2, 1)]
