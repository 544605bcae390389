"""Incremental ingest of wide weekly exports with Structured Streaming.

The source application prepares exports in batch; here the same prep
(canonical names, cleaning, week-set choice, unpivot, numeric coercion) runs
per micro-batch on CSV files as they land in a folder. Each batch is written
under its own ``batch_id=<n>`` folder with overwrite, so a replayed batch
(after a failure, foreachBatch is at-least-once) replaces its own output and
the sink stays exactly-once. Duplicate-grain collapse (B6) needs the whole
table and is applied when the accumulated long table is read
(:func:`read_ingested`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonepulse.operators import prep as P


def wide_schema(spark: SparkSession, sample_path: str) -> T.StructType:
    """All-text schema from the header of existing exports (file streams need one)."""
    header = spark.read.option("header", True).option("inferSchema", False).csv(sample_path).columns
    return T.StructType([T.StructField(c, T.StringType()) for c in header])


def start_wide_ingest(
    spark: SparkSession,
    source_dir: str,
    sink_dir: str,
    checkpoint_location: str,
    kind: str = "metrics",
    schema: T.StructType | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
):
    """Start the stream; returns the ``StreamingQuery``.

    ``checkpoint_location`` belongs to the sink for good: batch numbers are
    counted there, and a batch replaces the output of its own number only.
    The header of each file must have the schema's names in its order; other
    files are refused (``enforceSchema=false``).
    """
    if kind not in ("metrics", "orders"):
        raise ValueError(f"kind: expected metrics or orders, got {kind!r}")
    if not checkpoint_location:
        raise ValueError("a stream needs a checkpoint location that stays with its sink")
    reader = spark.readStream.schema(schema or wide_schema(spark, source_dir)).options(header=True, enforceSchema=False)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    stream = reader.csv(source_dir).select("*", split.alias("_split"))

    def process(batch: DataFrame, batch_id: int) -> None:
        place = F.struct("_split.file", "_split.block", F.monotonically_increasing_id().alias("row"))
        batch = batch.withColumn(P.ORD, place).drop("_split")
        long = P.reshape_metrics(batch, collapse=False) if kind == "metrics" else P.reshape_orders(batch)
        long.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_ingested(spark: SparkSession, sink_dir: str, kind: str = "metrics") -> DataFrame:
    """The accumulated long table; metrics get the duplicate-grain collapse,
    first values by week column, then batch, then place in the batch."""
    df = spark.read.parquet(sink_dir)
    if kind != "metrics":
        return df.drop("batch_id")
    order = F.struct(F.col(f"{P.ORD}.pos").alias("pos"), "batch_id", F.col(f"{P.ORD}.row").alias("row"))
    return P.collapse_duplicate_grain(df.withColumn(P.ORD, order).drop("batch_id"))
