"""Every registered query against its DuckDB oracle at sf0.001 (the driver's check, small)."""

import os

import pytest

import __spark_entry__ as E
from scripts.compare_oracle import compare, oracle_connection
from tests.conftest import SMALL_SF
from zonepulse.plans import registry

NAMES = sorted(registry.SPARK)


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SMALL_SF)


@pytest.mark.skipif(not os.path.isdir(SMALL_SF), reason="test data missing")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    line, ok = compare(spark, con, name, SMALL_SF)
    assert ok, line


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["rank", "zone", "value"]
    assert df.count() >= 0
