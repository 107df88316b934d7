"""Registered queries against their SQL, or run whole where SQL can't express them."""

import pytest

from lexmill.llm.queries import ORACLES, QUERIES
from tests.llm.sql_check import compare
from tests.oracle_check import connect


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, sf, name):
    assert compare(spark, connect(sf), sf, name)[0] == ""


def test_operators_in_order():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]


def test_entry_lists_them():
    import __spark_entry__ as contract

    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())
