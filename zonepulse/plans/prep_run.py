"""Prep and validation runs: wide exports → processed tables → quality report.

``prepare`` reads the two wide exports (A1), reshapes them (B1–B6), builds
the analytics base and features (B7–B9) and writes the four tables (A3);
``prepare_checked`` also gives the findings that need no look beyond a row.
``validate`` reads them back with explicit schemas (A2) and runs J1–J11.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from zonepulse.functions.columns import union_all
from zonepulse.model import FEATURE_COLUMNS, GEO_KEYS
from zonepulse.operators import prep as P
from zonepulse.operators import quality as Qy
from zonepulse.sources.exports import METRICS_EXPORT, ORDERS_EXPORT, find_exports, read_csv_by_name
from zonepulse.sources.tables import path_exists, read_long_table, read_wide_export, write_table

TABLES = ("metrics_long", "orders_long", "analytics_base", "metrics_features")


def prepare_checked(spark: SparkSession, wide_metrics_path: str, wide_orders_path: str, out_dir: str,
                    fmt: str = "parquet") -> tuple[dict[str, str], DataFrame]:
    """Write the four tables; returns their paths and the findings J1–J3 and J9 of the long ones.

    The base and the features are made from the written long tables, so each
    export is read and reshaped once. Parquet tables carry the key columns and
    are partitioned by week and metric: the tests every query starts with
    (``week = 0``, metric) prune folders, the filters reach the statistics.
    The findings come from figures that the writing tasks gather on their way.
    """
    paths = {name: f"{out_dir.rstrip('/')}/{name}{'.csv' if fmt == 'csv' else ''}" for name in TABLES}
    findings = []

    def write(name: str, df: DataFrame) -> None:
        figures = Observation(f"{name}-{uuid.uuid4().hex}")
        observed = (figures, Qy.observed_columns()) if name in TABLES[:3] else None
        if fmt == "csv":
            write_table(df, paths[name], fmt="csv", observed=observed)
        else:
            by_week = ("week", "metric_key") if "week" in df.columns else ("metric_key",)
            write_table(P.with_key_columns(df), paths[name], partition_by=by_week, observed=observed)
        if observed:
            seen = {k: int(v) for k, v in figures.get.items()}
            row = spark.createDataFrame([tuple(seen.values())], ", ".join(f"{k} long" for k in seen))
            findings.append(Qy.findings_of(row, name))

    write("metrics_long", P.reshape_metrics(read_wide_export(spark, wide_metrics_path)))
    write("orders_long", P.reshape_orders(read_wide_export(spark, wide_orders_path)))
    metrics, orders = read_long_table(spark, paths["metrics_long"], "metrics"), read_long_table(spark, paths["orders_long"], "orders")
    write("analytics_base", P.analytics_base(metrics, orders))
    write("metrics_features", P.metrics_features(metrics))
    return paths, union_all(findings)


def prepare(spark: SparkSession, wide_metrics_path: str, wide_orders_path: str, out_dir: str, fmt: str = "parquet") -> dict[str, str]:
    """``prepare_checked`` without its findings."""
    return prepare_checked(spark, wide_metrics_path, wide_orders_path, out_dir, fmt)[0]


def prepare_folder(spark: SparkSession, folder: str, out_dir: str, fmt: str = "parquet") -> dict[str, str]:
    """``prepare`` for a folder whose tables are found by their canonical names."""
    found = find_exports(spark, folder)
    return prepare(spark, found[METRICS_EXPORT], found[ORDERS_EXPORT], out_dir, fmt)


def load_processed(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    out = {name: read_long_table(spark, paths[name], "orders" if name == "orders_long" else "metrics") for name in TABLES[:3]}
    features = paths.get("metrics_features")
    if features and path_exists(spark, features):
        df = read_csv_by_name(spark, features) if features.rstrip("/").lower().endswith(".csv") else spark.read.parquet(features)
        numbers = [c for c in FEATURE_COLUMNS if c not in (*GEO_KEYS, "metric")]
        out["metrics_features"] = df.withColumns({c: F.col(c).try_cast("double") for c in numbers if c in df.columns})
    return out


def validate(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(findings, status) over the processed tables."""
    t = load_processed(spark, paths)
    findings = Qy.quality_report(t["metrics_long"], t["orders_long"], t["analytics_base"], t.get("metrics_features"))
    return findings, Qy.overall_status(findings)
