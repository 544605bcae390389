"""Sources (A1, A2) and sinks (A3, A4)."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonepulse.model import METRICS_LONG_SCHEMA, ORDERS_LONG_SCHEMA, require_columns
from zonepulse.operators.prep import ORD
from zonepulse.sources.exports import read_csv_by_name
from zonepulse.sources.storage import Folders, replace_table, settle


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver-generated parquet table (``<sf_dir>/<name>.parquet``)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _is_csv(path: str) -> bool:
    return path.lower().rstrip("/").endswith(".csv")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked of the file system that it belongs to."""
    return Folders(spark).exists(path)


def read_wide_export(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A1: one wide export per path, CSV (header, all text) or Parquet.

    CSV files may differ in the order of their columns and carry further ones
    (``exports.read_csv_by_name``). Cells stay text; the reshape step coerces
    them to numbers so that text such as "1,000" or "n/a" becomes null exactly
    like the export tool. Column ``_ord`` is the input order: file, place of
    the split in the file, row in the split, whatever task reads it.
    """
    fmt = fmt or ("csv" if _is_csv(path) else "parquet")
    settle(spark, path)
    if fmt == "csv":
        return read_csv_by_name(spark, path, with_order=True)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return spark.read.parquet(path).select("*", place.alias(ORD))


def read_long_table(spark: SparkSession, path: str, kind: str = "metrics") -> DataFrame:
    """A2: a processed long table with the model's types; columns are found by
    name in every file. Stored key columns (``<name>_key``) are kept.

    Only empty cells are null; the text "NA" stays a value (it is a country code).
    """
    schema = METRICS_LONG_SCHEMA if kind == "metrics" else ORDERS_LONG_SCHEMA
    settle(spark, path)
    df = read_csv_by_name(spark, path) if _is_csv(path) else spark.read.parquet(path)
    require_columns(df, schema.fieldNames(), path)
    keys = [c for c in df.columns if c.endswith("_key")]
    df = df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields], *keys)
    # NaN and null both mean missing.
    return df.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, only_partitions: bool = False,
                observed: tuple[Observation, list[Column]] | None = None) -> list[str]:
    """A3: write a table (CSV with header, or Parquet); returns the folders replaced.

    The rows go to a staging folder and are swapped in when they are whole, so
    a write that fails leaves the old table readable. ``only_partitions``
    replaces just the top-level partitions that ``df`` has (a week that newly
    arrived), not the table. Rows are dealt out by the partition columns first,
    so that a folder gets few files; adaptive execution splits a folder that
    outgrows a task. ``observed`` gathers figures of the rows in the tasks that
    write them, so that they cost no further scan.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if observed is not None:
        df = df.observe(observed[0], *observed[1])
    options = {"header": "true", "encoding": "UTF-8"} if fmt == "csv" else {}
    return replace_table(df, path, fmt, options, partition_by, only_partitions)


def write_report_lines(lines: DataFrame, path: str) -> None:
    """A4: write ordered report lines (columns ``ord``, ``line``) as one text file.

    The arguments of the insight run set the report's size (the summary and
    the sections' findings), so a single output partition is safe.
    """
    (
        lines.repartition(1)
        .sortWithinPartitions("ord")
        .select(F.col("line").cast(T.StringType()).alias("value"))
        .write.mode("overwrite")
        .text(path)
    )
