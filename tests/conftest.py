import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import zonepulse.sources.adapter as adapter  # noqa: E402
from zonepulse.model import METRICS_LONG_SCHEMA, ORDERS_LONG_SCHEMA  # noqa: E402
from zonepulse.session import build_session  # noqa: E402

_FACTS = {}
_zone_tables = adapter.zone_tables


def _zone_tables_once(spark, sf_dir, materialize=True):
    """The stored facts of a folder, made once for all tests (before the catalogs import the function)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if not materialize:
        return _zone_tables(spark, sf_dir, materialize=False)
    if key not in _FACTS:
        _FACTS[key] = _zone_tables(spark, sf_dir)
    return _FACTS[key]


adapter.zone_tables = _zone_tables_once

SMALL_SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


def metrics_rows(rows):
    """rows: (country, city, zone, zone_type, zone_prioritization, metric, week, value)."""
    return [(c, ci, z, zt, zp, m, w, f"l{w}w", float(v) if v is not None else None) for c, ci, z, zt, zp, m, w, v in rows]


@pytest.fixture
def make_tables(spark):
    def make(metrics=(), orders=()):
        m = spark.createDataFrame(metrics_rows(metrics), METRICS_LONG_SCHEMA)
        o = spark.createDataFrame(
            [(c, ci, z, "Orders", w, f"l{w}w", float(v)) for c, ci, z, w, v in orders], ORDERS_LONG_SCHEMA)
        return m, o

    return make
