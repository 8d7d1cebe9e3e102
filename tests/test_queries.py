"""Every bound query against its SQL counterpart, and what its plan must not hold."""

import contextlib
import io

import pytest

import __spark_entry__ as contract
from tablewright.plans import ORACLES, QUERIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
# No row of the smallest folder is deep enough.
EMPTY_WHEN_SMALL = {"ancestor_flatten"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        verdict = compare(df, con, ORACLES[name])
        assert verdict is None or (verdict == "no rows" and name in EMPTY_WHEN_SMALL), verdict
    else:
        assert df.count() > 0
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain("simple")
    assert "CartesianProduct" not in shown.getvalue()
    assert "BatchEvalPython" not in shown.getvalue()


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_only_wanted_columns_are_read(spark):
    files = QUERIES["calendar_histogram"](spark, FOLDER)
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        files.explain("simple")
    assert "o_totalprice" not in shown.getvalue()
