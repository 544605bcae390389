"""Training corpus from raw documents: five stages, each on all that its predecessor kept.

1. quality: a co-trained classifier; documents that it rejects go.
2. exact_dedup: of equal texts the row with the smallest doc_id stays.
3. near_dedup: of documents linked by five-word runs (similarity 0.8 or more) one stays.
4. suffix_dedup: byte strings of 200 bytes or more that occur twice leave the
   texts; every document stays, if need be with an empty text, and n_chars is
   that of the new text.
5. packing: the documents as sequences of at most 2,048 tokens.

A stage takes (spark, docs, sf_dir) and returns a frame, which must be written
before the next stage is called (``run`` does so): the next one deletes the
intermediate tables that the stage before it stored.

Null texts count as empty. An empty table passes through to an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonepulse.llm import exact_dedup, near_dedup, packing, quality, suffix_dedup
from zonepulse.llm.common import STORED, drop_stored, table
from zonepulse.session import shared_path, ship_package

_LEFT: dict[str, list[str]] = {}


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        app = spark.sparkContext.applicationId
        drop_stored(spark, _LEFT.pop(app, []))
        before = len(STORED)
        result = work(spark, docs, sf_dir)
        _LEFT[app] = STORED[before:]
        return result

    run_stage.__name__, run_stage.__doc__ = work.__name__, work.__doc__
    return run_stage


@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return quality.kept_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.kept_documents(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.kept_documents(docs, width=5, percent=80)


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without long strings that occur twice."""
    kept = suffix_dedup.kept_documents(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in kept.columns else kept


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: Classifier, similarity and tokenizer are beyond SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each result is written below the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, "pipeline", f"{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
