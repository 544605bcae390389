"""Removal of byte strings that occur twice, by blockwise suffix sorting with a difference cover.

A full suffix array of the corpus would move every byte position (at least
twelve bytes each) through a shuffle, many times the input. Suffixes are
therefore dealt into buckets by the winnowed anchor of their first ``length``
bytes (see ``anchors``): suffixes that agree on that many bytes fall into one
bucket. Buckets whose members all have one context are settled by a count; the
others are sorted, one block of whole buckets at a time, over the contexts of
their classes' first members only.

In a block the suffixes at a difference cover (positions whose remainder by 13
is 0, 1, 3 or 9) are ranked first, by prefix doubling. All suffixes are then
sorted by bucket, first 16 and last 24 of the ``length`` bytes. Ties are
resolved by the ranks of cover positions: any two positions have an offset
below 13 at which both lie in the cover, and the ranks there compare the bytes
between head and tail. The block's contexts are laid out in step, so that
equal suffixes mostly have equal remainders and one rank settles them. A task
holds about ``block_bytes`` of text, 4 in 13 positions' ranks, and nothing of
the rest of the corpus.

A bucket with more than ``most_contexts`` different contexts (a common line in
many surroundings) could outgrow a block; its suffixes are compared by hashes in
aggregations that are summed on the map side, many neighbouring suffixes at
once where they repeat or differ together (see ``anchors.refined_ranges``).
Both ways cover every suffix.

Defined results. Null and empty texts have no bytes. Strings do not cross
documents; every row is a document, so all of a repeated row of ``length``
bytes or more is removed. An empty table gives an empty result. Extra columns
are not read. ``kept`` holds the remaining bytes, which may cut a character in
two; ``kept_documents`` drops such halves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.anchors import KEY, anchor_table, covered, keyed, marked_ranges, refined_ranges, runs, same_document
from zonepulse.llm.common import stored, text_rows, worker_state
from zonepulse.llm.hashing import BYTES

PERIOD, COVER = 13, (0, 1, 3, 9)
SLOT = np.full(PERIOD, -1)
SLOT[list(COVER)] = range(len(COVER))
#: MEET[a, b]: the least offset at which positions with remainders a and b are both in the cover.
MEET = np.array([[next(d for d in range(PERIOD) if SLOT[(a + d) % PERIOD] >= 0 and SLOT[(b + d) % PERIOD] >= 0) for b in range(PERIOD)] for a in range(PERIOD)])
HEAD, TAIL = 16, 24
#: Shorter strings than this leave no room between head and tail.
LEAST_LENGTH = 2 * PERIOD


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Ranks from 1 of rows by their columns, the first counting most."""
    order = np.lexsort(columns[::-1])
    step = np.zeros(len(order), bool)
    if len(order):
        step[0] = True
    for c in columns:
        step[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(step)
    return out


class CoverRanks:
    """Ranks of a block's cover positions by their next ``depth`` bytes."""

    def __init__(self, packed: np.ndarray, n: int, depth: int):
        base = np.arange(0, n + PERIOD, PERIOD)
        at = (base[:, None] + np.array(COVER)[None, :]).ravel()
        self.rank, have = _dense(packed[at], packed[at + 5]), PERIOD
        while have < depth:
            step = min(have, depth - have)
            shift = len(COVER) * (step // PERIOD)
            further = np.concatenate([self.rank[shift:], np.zeros(min(shift, len(self.rank)), np.int64)])[: len(self.rank)]
            _, self.rank = np.unique(self.rank * (self.rank.max() + 1) + further, return_inverse=True)
            self.rank += 1
            have += step

    def at(self, place: np.ndarray) -> np.ndarray:
        return self.rank[place // PERIOD * len(COVER) + SLOT[place % PERIOD]]


def repeated_starts(data: np.ndarray, starts: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes at ``starts`` share their first ``length`` bytes with another one of their bucket."""
    out = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return out
    n = len(data)
    padded = np.concatenate([data, np.zeros(length + 64, np.uint8)]).astype(np.uint64)
    packed = np.zeros(n + length + 32, np.uint64)
    for i in range(8):
        packed |= padded[i : i + len(packed)] << np.uint64(56 - 8 * i)
    depth = (length - PERIOD + 1) // PERIOD * PERIOD
    ranks = CoverRanks(packed, n, depth)

    ends = [packed[starts], packed[starts + 8], *(packed[starts + length - d] for d in (24, 16, 8))]
    group = _dense(bucket, *ends)
    tied = np.flatnonzero(np.bincount(group)[group] > 1)
    place, group, rest = starts[tied], group[tied], starts[tied] % PERIOD
    width = ranks.rank.max() + 1

    own = (group * width + ranks.at(place + MEET[rest, rest])) * PERIOD + rest
    _, which, times = np.unique(own, return_inverse=True, return_counts=True)
    same = times[which] > 1

    low, high = np.full(group.max() + 1 if len(group) else 0, PERIOD), np.full(group.max() + 1 if len(group) else 0, -1)
    np.minimum.at(low, group, rest)
    np.maximum.at(high, group, rest)
    mixed = np.flatnonzero(low[group] != high[group])  # remainders differ: compare each two of them where they meet
    by_rest = [mixed[rest[mixed] == r] for r in range(PERIOD)]
    for a in range(PERIOD):
        for b in range(a + 1, PERIOD):
            one, two = by_rest[a], by_rest[b]
            if len(one) and len(two):
                x = group[one] * width + ranks.at(place[one] + MEET[a, b])
                y = group[two] * width + ranks.at(place[two] + MEET[a, b])
                same[one] |= np.isin(x, y)
                same[two] |= np.isin(y, x)
    out[tied] = same
    return out


def sort_block(rows: list[tuple[int, bytes, int, int]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (bucket, context, windows, place of the anchor): row, first and number of each run of repeated windows."""
    parts, bases, at = [], [], 0
    for _, context, _, anchor in rows:
        gap = -(at + anchor) % PERIOD  # anchors in step
        parts += [b"\0" * gap, context]
        bases.append(at + gap)
        at += gap + len(context)
    counts = np.array([r[2] for r in rows])
    row = np.repeat(np.arange(len(rows)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(np.array(bases), counts) + offset
    buckets = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
    found = np.flatnonzero(repeated_starts(np.frombuffer(b"".join(parts), np.uint8), starts, buckets[row], length))
    first, n = runs(offset[found] + row[found] * (1 << 40), row[found])
    return first >> 40, first & ((1 << 40) - 1), n


def _byte_hashes(data: np.ndarray) -> np.ndarray:
    return BYTES[data]


RANGE_KIND = "doc_id long, text_hash long, start long, n long"


def _range_batch(ids: list, hashes: list, starts: list, counts: list) -> pa.RecordBatch:
    cols = [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "start", "n"])


def repeated_ranges(texts: DataFrame, length: int, seed: int, most_contexts: int, block_bytes: int) -> DataFrame:
    """doc_id, text_hash, ranges: the windows of each document that also start elsewhere."""
    if length < LEAST_LENGTH or not 0 < seed <= length:
        raise ValueError(f"length must be {LEAST_LENGTH} or more and hold the seed")
    found = anchor_table(texts, _byte_hashes, length, seed)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), *KEY, "start", "n", "anchor")
    classes = stored(found.groupBy("seed", "context").agg(F.count("*").alias("uses"), F.min(place).alias("first")), "classes")
    members = stored(found.join(classes.select("seed", "context", "uses"), ["seed", "context"]).select(*KEY, "start", "n", "uses"), "members")
    whole = members.where("uses > 1").select(*KEY, "start", F.col("n").cast("long").alias("n"))

    several = classes.groupBy("seed").agg(F.count("*").alias("contexts")).where("contexts > 1")
    firsts = classes.join(several, "seed").select("seed", (F.col("contexts") > most_contexts).alias("hot"), "first.*")
    wanted = firsts.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n", "anchor", "seed", "hot")).alias("ranges"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("suffix_dedup")
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("text")[i].as_buffer().to_pybytes()
                ranges = batch.column("ranges")[i].values
                cut = zip(ranges.field("start").to_pylist(), ranges.field("n").to_pylist(), strict=True)
                of = pa.array(np.full(len(ranges), i))
                yield pa.RecordBatch.from_pydict(
                    {c: batch.column(c).take(of) for c in KEY}
                    | {c: ranges.field(c) for c in ("start", "n", "anchor", "seed", "hot")}
                    | {"context": pa.array([data[s : s + n + length - 1] for s, n in cut], pa.binary())}
                )

    picked = texts.join(wanted, same_document(texts, wanted)).select(texts["doc_id"], texts["text_hash"], "text", "ranges")
    kind = "doc_id long, text_hash long, start long, n int, anchor int, seed long, hot boolean, context binary"
    cut = stored(picked.mapInArrow(contexts, kind), "contexts")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("suffix_dedup")
        rows: list[tuple] = []
        size = 0

        def settled() -> pa.RecordBatch:
            row, first, n = sort_block([r[3:] for r in rows], length)
            mine = [rows[r] for r in row]
            return _range_batch([r[0] for r in mine], [r[1] for r in mine], [r[2] + int(f) for r, f in zip(mine, first, strict=True)], n.tolist())

        for batch in batches:
            names = ("doc_id", "text_hash", "start", "seed", "context", "n", "anchor")
            for r in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if size >= block_bytes and r[3] != rows[-1][3]:
                    yield settled()
                    rows, size = [], 0
                rows.append(r)
                size += len(r[4])
        if rows:
            yield settled()

    blocks = cut.where("not hot").select(*KEY, "start", "n", "anchor", "seed", "context").repartition("seed").sortWithinPartitions("seed")
    sorted_ranges = stored(blocks.mapInArrow(sort, RANGE_KIND), "sorted")

    hot = refined_ranges(cut.where("hot").drop("hot"), _byte_hashes, 1, length, length - seed + 1)
    return stored(marked_ranges(whole, sorted_ranges, hot), "ranges")


def suffix_dedup(
    docs: DataFrame,
    length: int = 200,
    seed: int = 64,
    most_contexts: int = 512,
    block_bytes: int = 1 << 18,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (bytes), carried (the columns to ``carry``)."""
    texts = keyed(text_rows(docs, id_col, text_col))
    ranges = repeated_ranges(texts, length, seed, most_contexts, block_bytes)
    carried = F.struct(F.lit(None).cast("int").alias("nothing"), *carry)
    texts = keyed(text_rows(docs.withColumn("__carried", carried), id_col, text_col, "__carried"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("suffix_dedup")
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sizes, removed, spans, kept = [], [], [], []
                for text, marks in zip(batch.column("text"), batch.column("ranges"), strict=True):
                    data = text.as_buffer().to_pybytes()
                    sizes.append(len(data))
                    if not marks.is_valid:
                        removed.append(0)
                        spans.append(0)
                        kept.append(data)
                        continue
                    found = marks.values
                    gone = covered(len(data), found.field("start").to_numpy(), found.field("n").to_numpy(), length)
                    removed.append(int(gone.sum()))
                    spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                    kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "n_bytes": pa.array(sizes, pa.int64()),
                        "n_removed": pa.array(removed, pa.int64()),
                        "n_spans": pa.array(spans, pa.int64()),
                        "kept": pa.array(kept, pa.binary()),
                        "carried": batch.column("carried"),
                    }
                )

    all_texts = texts.join(ranges, same_document(texts, ranges), "left").select(
        texts["doc_id"], "text", "ranges", F.col("__carried").alias("carried")
    )
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, carried " + all_texts.schema["carried"].dataType.simpleString()
    return all_texts.mapInArrow(remove, kind)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All rows of ``docs`` and their columns, the text without what repeats (and without halves of characters at the cuts)."""

    @F.pandas_udf("string")
    def characters(kept):
        return kept.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    result = suffix_dedup(docs, id_col=id_col, text_col=text_col, carry=tuple(docs.columns), **options)
    text = F.when(F.col("n_removed") == 0, F.col(f"carried.`{text_col}`")).otherwise(characters("kept"))
    return result.select(*[text.alias(c) if c == text_col else F.col(f"carried.`{c}`").alias(c) for c in docs.columns])


def digests(result: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
