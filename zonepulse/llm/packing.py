"""Packing tokenised documents into sequences by a grouping genetic algorithm.

Pieces of full length are sequences of their own. All others are dealt into
blocks of about ``block_items`` pieces by a hash. A block is evolved on several
islands, each with a population of groupings; a grouping is a list of bins.
Crossover injects a random half of one parent's well-filled bins into the
other, drops the receiver's bins that hold a piece already placed and puts
their other pieces back by best fit, longest first or in a shaken order. An
epoch ends at the lower bound of a block, or after eight children in a row
without a better grouping. After each epoch every
island's best grouping migrates to the next island of its block (a join of the
stored populations). Fitness is the mean squared fill, so fewer and fuller
bins win. The first individual of the first island starts as best-fit
decreasing, so that no result is worse than that.

Bins that end well below capacity, about one a block, are dissolved and packed
again in fewer blocks, until one block is left. Everything a task holds is one
block: some 4,096 lengths and a few groupings.

Defined results. Null and empty texts are one piece of one token (the closing
id). Repeated rows are packed each. An empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

import array
import bisect
import json
import random
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.common import stored, text_rows, with_row_id, worker_state
from zonepulse.llm.token_counts import TO_CHARACTERS

#: Letters up to U+012F, whose lower case and normal form are single letters, and ASCII marks behind them, no apostrophe.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-į]+)([!-&(-/:-@\[-`{-~]*)")


class WordIds(dict):
    """The ids of a word as little-endian unsigned 32-bit integers, worked out when first asked for.

    Plain words are what the tokenizer's rules make of letters: lower case,
    one pre-token, then the merges. All others go through the whole tokenizer.
    A full cache is emptied.
    """

    def __init__(self, blob: str, words: int, stems: int):
        super().__init__()
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(blob)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most_words, self.most_stems, self.stems = words, stems, {}
        parts = json.loads(blob)
        steps = [p["type"] for p in (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        norms = [p["type"] for p in (parts.get("normalizer") or {}).get("normalizers", [])]
        self.plain = steps == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"]
        #: words may be encoded apart: white space is dropped and no special string holds or takes any
        self.apart = self.plain and not any(set(" \n") & set(t["content"]) or t["lstrip"] or t["rstrip"] for t in parts["added_tokens"])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def stem(self, letters: str) -> bytes:
        ids = self.stems.get(letters)
        if ids is None:
            if len(self.stems) >= self.most_stems:
                self.stems.clear()
            tokens = self.tokenizer.model.tokenize(letters if letters.isascii() else letters.encode().decode("latin-1").translate(TO_CHARACTERS))
            ids = self.stems[letters] = array.array("I", [t.id for t in tokens]).tobytes()
        return ids

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most_words:
            self.clear()
        plain = PLAIN.fullmatch(word)
        if plain is None:
            ids = self[word] = self.whole(word)
        else:
            ids = self[word] = self.stem(plain[1].lower()) + (self.stem(plain[2]) if plain[2] else b"")
        return ids

    def text(self, text: str) -> bytes:
        if not self.apart:
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def worker_ids(shared, words: int, stems: int) -> WordIds:
    """The worker's tokenizer and cache, kept from task to task."""
    state = worker_state(shared.value["key"])
    if "ids" not in state:
        state["ids"] = WordIds(shared.value["blob"], words, stems)
    return state["ids"]


def tokenised_pieces(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    cache_words: int = 300_000,
    cache_stems: int = 700_000,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids."""
    with open(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast({"key": uuid.uuid4().hex, "blob": f.read()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, known = np.array([end_id], "<u4").tobytes(), worker_ids(shared, cache_words, cache_stems)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    ids = known.text(text.as_py()) + end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[start : start + 4 * capacity]
                        for c, v in zip(out, (doc_id, piece, start // 4, len(cut) // 4, zlib.crc32(cut), cut), strict=True):
                            out[c].append(v)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out["doc_id"], pa.int64()),
                        pa.array(out["piece"], pa.int32()),
                        pa.array(out["start"], pa.int64()),
                        pa.array(out["length"], pa.int64()),
                        pa.array(out["ids_crc32"], pa.int64()),
                        pa.array(out["ids"], pa.binary()),
                    ],
                    list(out),
                )

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    return text_rows(docs, id_col, text_col).mapInArrow(run, kind)


# --- one block: groupings of pieces, a bin is a list of item numbers ---------------------------------


def best_fit(bins: list[list[int]], fill: list[int], items: list[int], lengths: list[int], capacity: int) -> None:
    """Put the items, in the order given, each into the fullest bin with room for it."""
    room = sorted((capacity - f, b) for b, f in enumerate(fill) if f < capacity)
    for item in items:
        at = bisect.bisect_left(room, (lengths[item], -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([])
            fill.append(0)
        bins[b].append(item)
        fill[b] += lengths[item]
        if left > lengths[item]:
            bisect.insort(room, (left - lengths[item], b))


def longest_first(items, lengths: list[int]) -> list[int]:
    return sorted(items, key=lambda i: (-lengths[i], i))


def shaken(items, lengths: list[int], rng: random.Random) -> list[int]:
    """Longest first, but with each length taken up to a quarter, a half or three quarters shorter."""
    most = rng.choice((0.25, 0.5, 0.75))
    return sorted(items, key=lambda i: -lengths[i] * (1 - most * rng.random()))


def founder(lengths: list[int], capacity: int, rng: random.Random | None) -> list[list[int]]:
    """Best-fit decreasing; with ``rng``, in a shaken order."""
    order = range(len(lengths))
    order = longest_first(order, lengths) if rng is None else shaken(order, lengths, rng)
    bins: list[list[int]] = []
    best_fit(bins, [], order, lengths, capacity)
    return bins


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    fills = [sum(lengths[i] for i in b) / capacity for b in bins]
    return -len(bins), sum(f * f for f in fills)


def crossover(giver: list[list[int]], taker: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Whole well-filled bins of the giver, what they leave whole of the taker, displaced pieces by best fit (longest first or shaken)."""
    good = [b for b in giver if sum(lengths[i] for i in b) >= 0.98 * capacity and rng.random() < 0.5]
    placed = {i for b in good for i in b}
    child, displaced = [list(b) for b in good], []
    for b in taker:
        if placed.isdisjoint(b):
            child.append(list(b))
        else:
            displaced += [i for i in b if i not in placed]
    order = longest_first(displaced, lengths) if rng.random() < 0.5 else shaken(displaced, lengths, rng)
    best_fit(child, [sum(lengths[i] for i in b) for b in child], order, lengths, capacity)
    return child


def to_labels(bins: list[list[int]], n: int) -> list[int]:
    labels = [0] * n
    for b, items in enumerate(bins):
        for i in items:
            labels[i] = b
    return labels


def to_bins(labels: list[int]) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(max(labels, default=-1) + 1)]
    for i, b in enumerate(labels):
        bins[b].append(i)
    return [b for b in bins if b]


def evolve(
    lengths: list[int], population: list[list[int]], island: int, epoch: int, size: int, generations: int, capacity: int, stall: int = 8
) -> list[list[int]]:
    """The next population, best first.

    Ends at the lower bound of the number of bins, after ``generations``, or
    after ``stall`` of them in a row without a better best grouping. A child as
    fit as a member of the population is that member again, or as good as it,
    and is not taken, so that the population stays mixed.
    """
    rng = random.Random(len(lengths) * 1_000_003 + island * 101 + epoch)
    least, idle = -(-sum(lengths) // capacity), 0
    groups = [to_bins(p) for p in population]
    while len(groups) < size and min(map(len, groups), default=least + 1) > least:
        groups.append(founder(lengths, capacity, None if island == 0 and not groups else rng))
    ranked = sorted(((fitness(g, lengths, capacity), g) for g in groups), key=lambda r: r[0], reverse=True)
    for _ in range(generations):
        if -ranked[0][0][0] == least or idle >= stall or len(ranked) < 2:
            break
        (_, a), (_, b) = rng.sample(ranked, 2)
        child = crossover(a, b, lengths, capacity, rng)
        score, best = fitness(child, lengths, capacity), ranked[0][0]
        if all(score != other for other, _ in ranked):
            ranked = sorted([*ranked, (score, child)], key=lambda r: r[0], reverse=True)[:size]
        idle = 0 if ranked[0][0] > best else idle + 1
    return [to_labels(g, len(lengths)) for _, g in ranked[:size]]


def _pack_blocks(items: DataFrame, n_blocks: int, capacity: int, islands: int, epochs: int, size: int, generations: int) -> DataFrame:
    """uid, length, block, bin, offset, fill of each item."""
    block = F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).alias("block")
    members = F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("items")
    state = (
        items.groupBy(block)
        .agg(members)
        .select(
            "block",
            "items",
            F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
            F.array().cast("array<array<int>>").alias("population"),
        )
    )
    # the blocks are large rows: each task holds one of them at a time
    state = state.repartition(max(1, min(islands * n_blocks, 4 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "block", "island")

    def step(epoch: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_state("packing")
            for batch in batches:
                for at in range(batch.num_rows):
                    one = batch.slice(at, 1)
                    lengths = one.column("items")[0].values.field("length").to_pylist()
                    island = one.column("island")[0].as_py()
                    population = one.column("population")[0].as_py()
                    evolved = evolve(lengths, population, island, epoch, size, generations, capacity)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": one.column("block"),
                            "items": one.column("items"),
                            "island": one.column("island"),
                            "population": pa.array([evolved], pa.list_(pa.list_(pa.int32()))),
                        }
                    )

        return run

    kind = "block long, items array<struct<uid:long,length:long>>, island int, population array<array<int>>"
    for epoch in range(epochs):
        if epoch:
            elites = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("population")[0].alias("elite"))
            state = state.join(elites, ["block", "island"]).select(
                "block", "items", "island", F.concat("population", F.array("elite")).alias("population")
            )
        state = stored(state.select("block", "items", "island", "population").mapInArrow(step(epoch), kind), "islands")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = [i["length"] for i in row["items"]]
                out: list[tuple] = []
                for b, members in enumerate(to_bins(row["best"])):
                    offset, fill = 0, sum(lengths[i] for i in members)
                    for i in members:
                        out.append((row["items"][i]["uid"], lengths[i], row["block"], b, offset, fill))
                        offset += lengths[i]
                cols = list(zip(*out, strict=True)) or [()] * 6
                names = ("uid", "length", "block", "bin", "offset", "fill")
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    n_bins = F.array_max(F.col("population")[0])
    best = state.groupBy("block").agg(F.min(F.struct(n_bins.alias("bins"), "island")).alias("w"))
    chosen = state.join(best.select("block", F.col("w.island").alias("island")), ["block", "island"])
    chosen = chosen.select("block", "items", F.col("population")[0].alias("best"))
    return chosen.mapInArrow(place, "uid long, length long, block long, bin long, offset long, fill long")


def pack(
    items: DataFrame,
    capacity: int = 2048,
    block_items: int = 4096,
    islands: int = 2,
    epochs: int = 2,
    size: int = 3,
    generations: int = 40,
    reopen: float = 0.97,
) -> DataFrame:
    """``items`` (uid long, length long of 1..capacity) placed: uid, sequence_id, offset."""
    full = items.where(F.col("length") >= capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed, rest, level, before = full, items.where(F.col("length") < capacity), 0, None
    while True:
        n = rest.count()
        if not n:
            return placed
        n_blocks = -(-n // block_items)
        done = stored(_pack_blocks(rest, n_blocks, capacity, islands, epochs, size, generations), "placed")
        last = n_blocks == 1 or (before is not None and n > before / 2)
        closed = done if last else done.where(F.col("fill") >= reopen * capacity)
        # up to 2^20 bins a block and 2^36 blocks at each of 32 levels
        number = F.lit(level * 2**57) + F.col("block") * 2**20 + F.col("bin")
        placed = placed.unionByName(closed.select("uid", number.alias("sequence_id"), "offset"))
        if last:
            return placed
        rest, level, before = done.where(F.col("fill") < reopen * capacity).select("uid", "length"), level + 1, n


def packed_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048, **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(with_row_id(tokenised_pieces(docs, tokenizer_path, capacity).drop("ids"), "uid"), "pieces")
    placed = pack(pieces.select("uid", "length"), capacity, **options)
    return pieces.join(placed, "uid").drop("uid")
