"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonepulse.session import shared_path, ship_package

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"

#: Folders that ``stored`` has written, in order.
STORED: list[str] = []

#: While a table is written: drop its shuffle files at the end; hand texts to Python in batches of bounded rows and bytes.
WHILE_STORING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark's own reader (any store)."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    This cuts the lineage: an executor lost later costs no recomputation of
    what lies before. The shuffle files of the write are dropped as soon as
    it ends, so the peak of disk use is that of one step, not of their sum.
    """
    spark = df.sparkSession
    path = shared_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    before = {key: spark.conf.get(key, None) for key in WHILE_STORING}
    try:
        for key, value in WHILE_STORING.items():
            spark.conf.set(key, value)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


_WORKER: dict = {}


def worker_state(owner: str) -> dict:
    """What this Python worker keeps from task to task for one run of an operator.

    Workers outlive an operator; what another one has kept (tokenizers, word
    caches) is dropped here, so that memory does not add up over a pipeline.
    """
    if _WORKER.get("owner") != owner:
        _WORKER.clear()
        _WORKER["owner"] = owner
    return _WORKER


def drop_stored(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that ``stored`` has written, in whatever file system they are."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        STORED.remove(path)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A number for each row; steady only once the result is stored."""
    return df.withColumn(name, F.monotonically_increasing_id())


def text_rows(docs: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    """Only the columns an operator reads, as (doc_id long, text string) and ``others``; null text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *others
    )


def rows_named(docs: DataFrame, verdicts: DataFrame, digest: Column, id_col: str) -> DataFrame:
    """The rows of ``docs`` that stay, one of those that share id and text.

    ``verdicts`` has a row for each of ``docs``: id, digest of the text, and
    whether it stays. Only ids that share a text with themselves (repeated
    rows) pass through a grouping of whole rows.
    """
    id_name, digest_name, stays = verdicts.columns
    names = verdicts.groupBy(F.col(id_name).alias("__id"), F.col(digest_name).alias("__digest")).agg(
        F.count("*").alias("__copies"), F.max(stays).alias("__stays")
    )
    names = stored(names.where("__stays").drop("__stays"), "names")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__digest"))
    marked = docs.withColumn("__own", digest)
    found = marked.join(names.where("__copies = 1"), same)
    repeated = names.where("__copies > 1")
    if not repeated.isEmpty():
        found = found.unionByName(marked.join(repeated, same).dropDuplicates(["__id", "__digest"]))
    return found.drop("__id", "__digest", "__own", "__copies")
