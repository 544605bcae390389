"""Reports kept with the key of what they were made from.

A report is made anew only if one of its two tables, an argument or the
report's format has changed. The key is stored beside the lines, written after
them; a folder without a readable key counts as empty.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from zonepulse.model import METRICS_LONG_SCHEMA, ORDERS_LONG_SCHEMA
from zonepulse.operators.fingerprint import fingerprint
from zonepulse.plans.insights import run_insights
from zonepulse.plans.report import report_lines
from zonepulse.sources.storage import Folders, replace_table, settle

#: Raised whenever the report's content or layout changes.
FORMAT = 1


def report_key(metrics_df: DataFrame, orders_df: DataFrame, **arguments) -> dict:
    """What a report depends on: both tables' contents and types, the arguments, the format."""
    tables = {
        "metrics": metrics_df.select(*METRICS_LONG_SCHEMA.fieldNames()),
        "orders": orders_df.select(*ORDERS_LONG_SCHEMA.fieldNames()),
    }
    prints = {name: fingerprint(df).first() for name, df in tables.items()}
    return {
        **{name: {"fingerprint": row["fingerprint"], "rows": row["row_count"]} for name, row in prints.items()},
        "arguments": {k: arguments[k] for k in sorted(arguments)},
        "format": FORMAT,
    }


def stored_key(spark: SparkSession, folder: str) -> dict | None:
    path = f"{folder.rstrip('/')}/key"
    settle(spark, path)
    if not Folders(spark).exists(path):
        return None
    try:
        return json.loads("".join(r["value"] for r in spark.read.text(path).collect()))
    except ValueError:
        return None


def cached_report(
    metrics_df: DataFrame, orders_df: DataFrame, folder: str, top_k_critical: int = 5, max_per_category: int = 3
) -> tuple[DataFrame, bool]:
    """((ord, line) rows of the report, whether they were there already)."""
    spark = metrics_df.sparkSession
    arguments = {"top_k_critical": top_k_critical, "max_per_category": max_per_category}
    key = report_key(metrics_df, orders_df, **arguments)
    lines, keys = f"{folder.rstrip('/')}/lines", f"{folder.rstrip('/')}/key"
    folders = Folders(spark)
    folders.make(folder)
    settle(spark, lines)
    if stored_key(spark, folder) == key and folders.exists(lines):
        return spark.read.parquet(lines), True
    folders.delete(keys)  # no key beside lines that are not its own
    replace_table(report_lines(run_insights(metrics_df, orders_df, **arguments)), lines, "parquet", {})
    told = spark.createDataFrame([(json.dumps(key, sort_keys=True),)], "value string")
    replace_table(told.coalesce(1), keys, "text", {})
    return spark.read.parquet(lines), False
