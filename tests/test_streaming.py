"""Streaming ingest of wide exports equals the batch reshape."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from zonepulse.operators import prep as P
from zonepulse.sources import fixtures as X
from zonepulse.sources.adapter import zone_tables
from zonepulse.sources.tables import read_wide_export
from zonepulse.streaming.wide_ingest import read_ingested, start_wide_ingest
from tests.conftest import SMALL_SF


def test_stream_matches_batch(spark):
    m, _ = zone_tables(spark, SMALL_SF)
    wide = X.wide_metrics(m).select("*")
    work = tempfile.mkdtemp(prefix="zp-stream-")
    src, sink = os.path.join(work, "in"), os.path.join(work, "out")
    wide.repartition(3).write.option("header", True).csv(src)
    q = start_wide_ingest(spark, src, sink, os.path.join(work, "ckpt"))
    q.awaitTermination(300)
    streamed = read_ingested(spark, sink, "metrics")
    batch = P.reshape_metrics(read_wide_export(spark, src, "csv"))
    cols = sorted(batch.columns)
    assert streamed.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert batch.select(cols).exceptAll(streamed.select(cols)).count() == 0
    assert streamed.count() == m.count()
    # a restart goes on counting batches: nothing that was written is replaced
    wide.limit(5).withColumn("Zone", F.lit("New zone")).coalesce(1).write.mode("append").option("header", True).csv(src)
    start_wide_ingest(spark, src, sink, os.path.join(work, "ckpt")).awaitTermination(300)
    assert sorted(os.listdir(sink)) == ["batch_id=0", "batch_id=1"]
    assert read_ingested(spark, sink, "metrics").where("zone <> 'New zone'").count() == m.count()


def test_stream_needs_a_lasting_checkpoint(spark, tmp_path):
    with pytest.raises(ValueError, match="checkpoint"):
        start_wide_ingest(spark, str(tmp_path), str(tmp_path / "out"), "")
