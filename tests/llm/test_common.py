"""Helpers of the training-data operators."""

import os

from pyspark.sql import functions as F

from zonepulse.llm import common


def test_stored_tables_are_read_back_and_dropped(spark):
    before = {k: spark.conf.get(k, None) for k in common.WHILE_STORING}
    made = common.stored(spark.range(5).select("id", F.lit(None).cast("string").alias("none")), "things")
    assert made.count() == 5 and made.columns == ["id", "none"]
    assert {k: spark.conf.get(k, None) for k in common.WHILE_STORING} == before
    path = common.STORED[-1]
    common.drop_stored(spark, [path])
    assert path not in common.STORED and not os.path.exists(path.removeprefix("file:"))


def test_a_worker_drops_what_another_operator_kept():
    state = common.worker_state("one")
    state["cache"] = 1
    assert common.worker_state("one")["cache"] == 1
    assert "cache" not in common.worker_state("two")


def test_one_of_repeated_rows_stays(spark):
    docs = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (1, "b", 7), (None, "a", 8), (2, "c", 9)], "doc_id long, text string, extra int")
    verdicts = spark.createDataFrame(
        [(1, "a", True), (1, "a", False), (1, "b", True), (None, "a", True), (2, "c", False)], "doc_id long, digest string, stays boolean")
    found = common.rows_named(docs, verdicts, F.col("text"), "doc_id")
    assert found.columns == docs.columns
    rows = sorted((r.doc_id or 0, r.text) for r in found.collect())
    assert rows == [(0, "a"), (1, "a"), (1, "b")]

