"""Every SQL-expressible query equals its DuckDB oracle (sf0.001)."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck

from conftest import SF

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    issues, *_ = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert not issues, issues


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert set(df.columns) >= {"attr", "dpd", "eod"}
