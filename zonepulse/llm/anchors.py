"""Winnowed anchors of windows: the seeds that repeats of a fixed length must share.

A window is ``length`` consecutive items (words or bytes). Its anchor is the
run of ``seed`` items with the least hash inside it, so equal windows have
equal anchors at equal places. An anchor serves a stretch of neighbouring
windows; the items these cover are its context.

* Anchors whose seed occurs once hold no repeat and are dropped first: one
  count by seed, one join (which the engine may split where a seed is hot).
* Anchors with equal contexts form a class; its first member stands for it.
* Only where a seed has several classes must single windows be compared, and
  only those of the classes' first members.

All groups are summed on the map side; no pairs of a group are made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.common import stored, worker_state
from zonepulse.llm.hashing import MIX2, U, mix, prefix_sums, sliding_argmin, span_hash, windows

#: Items of a long text that are worked on at once (each further part starts with the windows not yet served).
PART = 1 << 20

KEY = ["doc_id", "text_hash"]


def keyed(texts: DataFrame) -> DataFrame:
    """doc_id, text_hash, text: rows with the same id and text are one document to the joins below."""
    return texts.withColumn("text_hash", F.xxhash64("text"))


def same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


def anchors_of(items: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of item hashes, for each anchor: seed hash, context hash, first window's start, number of windows, place of the seed behind that start."""
    found: list[tuple] = []
    at = 0
    while len(items) - at >= length:
        part = items[at : at + PART + length - 1]
        grams = windows(part, seed)
        least = sliding_argmin(grams, length - seed + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [len(least)]])
        place = least[first]
        context = span_hash(prefix_sums(part, 1), first, last + length - 1, 1)
        with np.errstate(over="ignore"):
            context = mix(context + (place - first).astype(U) * MIX2)
        found.append((grams[place], context, first + at, last - first, place - first))
        at += PART
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(U), none.astype(U), none, none, none
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))  # type: ignore[return-value]


ANCHOR_KIND = "doc_id long, text_hash long, seed long, context long, start long, n int, anchor int"


def anchor_table(texts: DataFrame, items: Callable[[np.ndarray], np.ndarray], length: int, seed: int) -> DataFrame:
    """The anchors of all texts whose seed occurs more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("anchors")
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                parts = [anchors_of(items(np.frombuffer(t.as_buffer() or b"", np.uint8)), length, seed) for t in batch.column("text")]
                sizes = np.array([len(p[0]) for p in parts])
                of = pa.array(np.repeat(np.arange(len(parts)), sizes))
                cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").take(of),
                        "text_hash": batch.column("text_hash").take(of),
                        "seed": cols[0].view(np.int64),
                        "context": cols[1].view(np.int64),
                        "start": cols[2].astype(np.int64),
                        "n": cols[3].astype(np.int32),
                        "anchor": cols[4].astype(np.int32),
                    }
                )

    found = stored(texts.select(*KEY, "text").mapInArrow(run, ANCHOR_KIND), "anchors")
    many = found.groupBy("seed").agg(F.count("*").alias("uses")).where("uses > 1").select("seed")
    return stored(found.join(many, "seed"), "repeated-anchors")


def windows_of(items: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows of some anchors, with two 64-bit hashes of each."""
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    hashes = [span_hash(prefix_sums(items, w), at, at + length, w).view(np.int64) for w in (0, 1)]
    return at, hashes[0], hashes[1]


def refined_ranges(contexts: DataFrame, items: Callable[[np.ndarray], np.ndarray], width: int, length: int, most: int) -> DataFrame:
    """doc_id, text_hash, start, n: the repeated windows among contexts of seeds that have very many of them.

    ``contexts`` has one row per distinct context: doc_id, text_hash, seed,
    start, n, anchor and the context itself (``width`` bytes an item; ``items``
    gives the items' hashes). The windows of a context are cut into blocks by
    their offset from the seed. Blocks with equal contents repeat whole. What
    all windows of a block have in common must occur in two different blocks,
    else none of them can repeat; the first members of the others are cut into
    smaller blocks, down to single windows. So an edge of a passage that very
    many documents share costs a few rows a document, not one a window.
    """
    found = []
    sizes = [b for b in (32, 8, 2) if b < most] + [1]
    for size in sizes:
        if contexts.isEmpty():
            break
        blocks = stored(contexts.mapInArrow(_cut_blocks(items, width, length, size), BLOCK_KIND), "blocks")
        key = ["seed", "block", "common", "content"]
        place = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), *KEY, "start", "n", "anchor", "context")).alias("first")
        classes = blocks.groupBy(*key).agg(F.count("*").alias("uses"), place)
        classes = stored(classes, "block-classes")
        whole = blocks.drop("context").join(classes.where("uses > 1").select(*key), key)
        found.append(stored(whole.select(*KEY, "start", F.col("n").cast("long").alias("n")), "whole-blocks"))
        if size > 1:
            mixed = classes.groupBy(*key[:3]).agg(F.count("*").alias("contents")).where("contents > 1").select(*key[:3])
            contexts = classes.join(mixed, key[:3]).select("seed", "first.*").drop("no_id")
    return reduce(DataFrame.unionByName, found) if found else contexts.select(*KEY, "start", F.col("n").cast("long").alias("n"))


BLOCK_KIND = (
    "doc_id long, text_hash long, seed long, start long, n int, anchor int, block int, common long, content long, context binary"
)


def _cut_blocks(items: Callable[[np.ndarray], np.ndarray], width: int, length: int, size: int):
    """Task: the blocks of ``size`` offsets of each context, with a hash of what their windows share and one of all they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("anchors")
        for batch in batches:
            rows: list[tuple] = []
            for r in range(batch.num_rows):
                data = batch.column("context")[r].as_buffer().to_pybytes()
                n, anchor, start = (batch.column(c)[r].as_py() for c in ("n", "anchor", "start"))
                hashes = items(np.frombuffer(data, np.uint8))
                block = (anchor - np.arange(n)) // size
                first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                last = np.concatenate([first[1:], [n]])
                low = block[first] * size
                one, two = prefix_sums(hashes, 0), prefix_sums(hashes, 1)
                common = span_hash(one, anchor - low, anchor + length - (low + size - 1), 0)
                content = span_hash(two, first, last + length - 1, 1)
                for k, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
                    rows.append((r, start + a, b - a, anchor - a, int(block[a]), common[k], content[k], data[a * width : (b + length - 1) * width]))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            of = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c).take(of) for c in (*KEY, "seed")}
                | {
                    "start": pa.array(cols[1], pa.int64()),
                    "n": pa.array(cols[2], pa.int32()),
                    "anchor": pa.array(cols[3], pa.int32()),
                    "block": pa.array(cols[4], pa.int32()),
                    "common": pa.array(np.array(cols[5], U).view(np.int64)),
                    "content": pa.array(np.array(cols[6], U).view(np.int64)),
                    "context": pa.array(cols[7], pa.binary()),
                }
            )

    return run


def marked_ranges(*parts: DataFrame) -> DataFrame:
    """doc_id, text_hash, ranges: the windows to remove of each document, as (first start, number)."""
    ranges = parts[0]
    for p in parts[1:]:
        ranges = ranges.unionByName(p)
    return ranges.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("ranges"))


def covered(n_items: int, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Which items some window of the ranges covers."""
    edge = np.zeros(n_items + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def runs(at: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive numbers in ``at`` as (first, how many); a new run also starts where ``split`` changes."""
    if not len(at):
        return at, at
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (split[1:] != split[:-1])]))
    return at[first], np.diff(np.concatenate([first, [len(at)]]))
