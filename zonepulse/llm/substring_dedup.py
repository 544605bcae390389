"""Substring dedup over words: seed and extend.

Documents are joined on winnowed anchors (see ``anchors``): a window of
``length`` words that occurs twice has an anchor of ``seed`` words in common.
From its anchor each match is extended both ways as far as the anchor's
windows reach: equal contexts match whole; where one seed stands in different
contexts, the single windows of the contexts' first members are compared.
Neighbouring windows found this way join into maximal repeats, which are at
least ``length`` words long, and every word that a later occurrence covers is
removed.

An occurrence is later if the same words also start in a smaller doc_id, or
earlier in the same document; all is judged on the input. Words are runs
without the six white-space bytes and are compared by names (``named_words``:
their own bytes, or from eight bytes on a BLAKE2b under a key drawn for the
run), windows by two 64-bit hashes of the names.

Defined results. Null and empty texts have no words and the digest of the empty
text. Rows that repeat a doc_id and its text count as one document: none is
earlier than the other. Rows without an id come after all others. An empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.anchors import KEY, anchor_table, covered, keyed, marked_ranges, same_document, windows_of
from zonepulse.llm.common import stored, text_rows, worker_state
from zonepulse.llm.hashing import named_words, new_key

LAST = 2**63 - 1


def _word_names(data: np.ndarray, key: bytes) -> np.ndarray:
    return named_words(data, key)[0]


def repeated_ranges(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """doc_id, text_hash, ranges: the later windows of each document."""
    key = new_key()
    found = anchor_table(texts, partial(_word_names, key=key), length, seed)
    place = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "start")
    classes = found.groupBy("seed", "context").agg(F.min(place).alias("first"))
    classes = stored(classes, "classes")
    # later members of a class: all their windows start earlier in its first member
    members = found.join(classes.select("seed", F.col("context"), "first"), ["seed", "context"])
    members = stored(members.withColumn("later", place > F.col("first")).drop("first"), "members")
    whole = members.where("later").select(*KEY, "start", "n")

    several = classes.groupBy("seed").agg(F.count("*").alias("classes")).where("classes > 1").select("seed")
    firsts = members.where("not later").join(several, "seed").select(*KEY, "start", "n").distinct()
    wanted = firsts.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("ranges"))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("substring_dedup")
        for batch in batches:
            for i in range(batch.num_rows):
                items = _word_names(np.frombuffer(batch.column("text")[i].as_buffer() or b"", np.uint8), key)
                ranges = batch.column("ranges")[i].values
                counts = ranges.field("n").to_numpy().astype(np.int64)
                at, high, low = windows_of(items, ranges.field("start").to_numpy(), counts, length)
                of = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").take(of),
                        "text_hash": batch.column("text_hash").take(of),
                        "start": at,
                        "high": high,
                        "low": low,
                    }
                )

    picked = texts.join(wanted, same_document(texts, wanted)).select(texts["doc_id"], texts["text_hash"], "text", "ranges")
    windows = picked.mapInArrow(single, "doc_id long, text_hash long, start long, high long, low long")
    windows = stored(windows, "single-windows")
    repeated = windows.groupBy("high", "low").agg(F.count("*").alias("uses"), F.min(place).alias("first")).where("uses > 1")
    later = windows.join(repeated, ["high", "low"]).where(place > F.col("first")).select(*KEY, "start", F.lit(1).alias("n"))
    return stored(marked_ranges(whole, later), "later-ranges")


def substring_dedup(
    docs: DataFrame, length: int = 20, seed: int = 6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, n_repeats, text (the kept words joined by one space), kept_sha256."""
    texts = keyed(text_rows(docs, id_col, text_col))
    ranges = repeated_ranges(texts, length, seed)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("substring_dedup")
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: dict[str, list] = {"n_words": [], "n_removed": [], "n_repeats": [], "text": [], "kept_sha256": []}
                for text, marks in zip(batch.column("text"), batch.column("ranges"), strict=True):
                    words = text.as_py().encode().split()
                    gone = np.zeros(len(words), bool)
                    if marks.is_valid:
                        spans = marks.values
                        gone = covered(len(words), spans.field("start").to_numpy(), spans.field("n").to_numpy().astype(np.int64), length)
                        words = [words[i] for i in np.flatnonzero(~gone)]
                    kept = b" ".join(words)
                    out["n_words"].append(len(gone))
                    out["n_removed"].append(int(gone.sum()))
                    out["n_repeats"].append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                    out["text"].append(kept.decode())
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id")} | {c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)}
                )

    all_texts = texts.join(ranges, same_document(texts, ranges), "left").select(texts["doc_id"], "text", "ranges")
    return all_texts.mapInArrow(
        remove, "doc_id long, n_words long, n_removed long, n_repeats long, text string, kept_sha256 string"
    )
