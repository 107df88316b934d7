"""Registered queries against their SQL on the smallest tables."""

import pytest

from lexmill.plans.oracles import ORACLES
from lexmill.plans.queries import QUERIES
from tests.oracle_check import compare, connect

# fits of minutes without SQL; the fits themselves are compared in test_solver.py
SLOW = {"hier_fit_predict", "flat_fit_predict", "tune_flat"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_matches_sql(spark, con, sf, name):
    message, _ = compare(spark, con, sf, name)
    assert message == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {
        "hier_fit_predict", "flat_fit_predict", "tune_flat", "cluster_documents",
    }


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns == ["label", "percent"]
    assert contract.queries().keys() >= QUERIES.keys()
