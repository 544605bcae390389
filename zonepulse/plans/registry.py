"""Registered queries (Spark) and their DuckDB oracle SQL.

Every query reads the driver's tables through the adapter, so its work grows
with the data. Double columns are rounded to 6 decimals at the edge so that
float summation order cannot change the compared values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from zonepulse.functions.columns import round_doubles
from zonepulse.sources.adapter import ORACLE_BASE_CTE

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        SPARK[name] = run
        if sql is not None:
            SQL[name] = "WITH " + ORACLE_BASE_CTE + ",\n" + sql.strip()
        return fn

    return deco


def r6(expr: str) -> str:
    return f"round({expr}, 6)"



def load_all() -> None:
    """Import every catalog module (each registers its queries on import)."""
    from zonepulse.plans import (  # noqa: F401
        catalog_curation,
        catalog_detectors,
        catalog_narrative,
        catalog_prep,
        catalog_quality,
        catalog_queries,
        catalog_text,
    )
