"""Near-duplicate documents by HyperMinHash, banding and verification.

1. Every document's set of word runs is hashed, from names of the words
   (``named_words``) under a key that is drawn for the run. Its items are dealt into
   buckets; a bucket keeps, of its least hash, the number of leading zeros and
   ten mantissa bits (16-bit register). 240 registers in 40 bands of six. A
   large set fills 240 buckets in one dealing; a small one is dealt several
   times into fewer buckets, so that a bucket holds four items or more on
   average. How often depends on the power of two below the set's size; a set
   within a quarter of the next power is written for both, so that any two
   sets of similarity 0.8 have one scheme in common.
2. Documents with equal sets form a class; only its representative goes on.
3. Representatives that share a band are candidates. First each is paired with
   the least member of one of its bands (the one it shares most bands with).
   A pair is tested on registers: Jaccard similarity estimated from equal
   registers, corrected for the registers that two unrelated sets of these
   sizes would share; what is far too low (six standard errors) is dropped, the
   rest is verified on the full sets by whole-number arithmetic. Links found
   join components.
4. In bands whose members are of several components still, members outside
   the largest one are verified against all members, in blocks of bounded
   bytes; common items of all sets of two blocks are counted at once, without
   a row for a pair. Pairs within a component cannot change the result and are
   left out where a whole side is one.
5. Components of the links, spread to all members of the classes.

At similarity 0.8 a pair shares no band with probability 5e-6, above it less.

Defined results. Null, empty and wordless texts have no set: n_shingles 0, a
component of their own. Repeated rows are equal sets. component_id is the
smallest doc_id of the component (null ids last); kept is doc_id =
component_id, so of repeated rows with that id all are kept; ``kept_documents``
leaves one. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.common import rows_named, stored, text_rows, with_row_id, worker_state
from zonepulse.llm.components import components
from zonepulse.llm.hashing import MIX1, MIX2, U, mix, named_words, new_key, shingle_set

BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
EMPTY = 0xFFFF
#: Bits of a hash that a register describes, and mantissa bits kept.
VALUE_BITS, MANTISSA = 44, 10
#: Buckets in one dealing, by the power of two below the set's size (2^3, 2^4, ...); all 240 from 2^10 on.
BUCKETS = {0: 1, 1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 16, 7: 30, 8: 60, 9: 120}


def buckets_of(power: int) -> int:
    return BUCKETS.get(power, REGISTERS)


def powers_of(size: int) -> list[int]:
    """The schemes a set of this size is written for."""
    own = size.bit_length() - 1
    return [own, own + 1] if 5 * size >= 4 * 2 ** (own + 1) else [own]


def registers(items: np.ndarray, power: int) -> np.ndarray:
    """The 240 registers of a set of hashes, dealt as the scheme says."""
    buckets = buckets_of(power)
    deals = REGISTERS // buckets
    with np.errstate(over="ignore"):
        h = mix(items[:, None] + (np.arange(1, deals + 1, dtype=U) * MIX1)[None, :])
    bucket = (h >> U(VALUE_BITS)) % U(buckets) + (np.arange(deals, dtype=U) * U(buckets))[None, :]
    value = (h & U((1 << VALUE_BITS) - 1)).ravel()
    least = np.full(REGISTERS, 1 << VALUE_BITS, U)
    bucket = bucket.ravel().astype(np.int64)
    order = np.lexsort((value, bucket))
    slot, first = np.unique(bucket[order], return_index=True)
    least[slot] = value[order][first]
    return compressed(least)


def compressed(least: np.ndarray) -> np.ndarray:
    """Leading zeros (six bits) and mantissa (ten bits) of each value; 0xFFFF for an empty bucket."""
    bits = (least.astype(np.float64) + 0.5).view(np.uint64)
    zeros = VALUE_BITS - ((bits >> U(52)).astype(np.int64) - 1023)
    mantissa = ((bits >> U(52 - MANTISSA)) & U((1 << MANTISSA) - 1)).astype(np.int64)
    return np.where(least >> U(VALUE_BITS), EMPTY, (np.clip(zeros, 0, 62) << MANTISSA) | mantissa).astype(np.uint16)


def band_keys(regs: np.ndarray, power: int) -> np.ndarray:
    """A 64-bit key for each band that holds a register; bands with none give none."""
    rows = regs.reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=U) * MIX2 + U(power + 1)
        for c in range(ROWS):
            key = mix(key + rows[:, c].astype(U) * MIX1)
    return key[(rows != EMPTY).any(1)].view(np.int64)


@lru_cache(4096)
def accidental(load_a: float, load_b: float) -> float:
    """Probability that a bucket's registers agree for two sets without a common item, given mean items a bucket."""
    lows, highs = _cells()
    chance = lambda load: np.exp(-load * lows) - np.exp(-load * highs)  # noqa: E731  the least hash lies in the cell
    return float((chance(load_a) * chance(load_b)).sum())


@lru_cache(1)
def _cells() -> tuple[np.ndarray, np.ndarray]:
    zeros = np.arange(1, 33)[:, None]
    step = np.arange(1 << MANTISSA)[None, :] / (1 << MANTISSA)
    low = (1 + step) * 0.5**zeros
    return low.ravel(), (low + 0.5**zeros / (1 << MANTISSA)).ravel()


def estimate(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int, power: int) -> float:
    """Jaccard similarity from registers, corrected for accidental agreement."""
    used = (a != EMPTY) | (b != EMPTY)
    if not used.any():
        return 0.0
    agree = ((a == b) & used).sum() / used.sum()
    load = lambda n: round(n / buckets_of(power), 1 if n < 10_000 else 0)
    chance = accidental(load(size_a), load(size_b))
    return max(0.0, (agree - chance) / (1 - chance))


def set_hashes(items: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set of hashes, whatever the order."""
    with np.errstate(over="ignore"):
        hi, lo = mix(items ^ MIX1).sum(dtype=U), mix(items + MIX2).sum(dtype=U)
    return int(np.array([hi]).view(np.int64)[0]), int(np.array([lo]).view(np.int64)[0])


def _sets(batch: pa.RecordBatch, width: int, key: bytes) -> Iterator[tuple[int, np.ndarray]]:
    for i, text in enumerate(batch.column("text")):
        data = np.frombuffer(text.as_buffer() or b"", np.uint8)
        yield i, shingle_set(named_words(data, key, fold=True)[0], width)


def signatures(docs: DataFrame, width: int, key: bytes, id_col: str, text_col: str) -> DataFrame:
    """row_id, doc_id, text_md5, n_shingles, set_hi, set_lo, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("near_dedup")
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sizes, names, bands = [], [], []
                for _, items in _sets(batch, width, key):
                    sizes.append(len(items))
                    names.append(set_hashes(items))
                    keys = [band_keys(registers(items, p), p) for p in powers_of(len(items))] if len(items) else []
                    bands.append(np.concatenate(keys) if keys else np.zeros(0, np.int64))
                ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
                flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "text_md5": batch.column("text_md5"),
                        "n_shingles": pa.array(sizes, pa.int64()),
                        "set_hi": pa.array([h for h, _ in names], pa.int64()),
                        "set_lo": pa.array([l for _, l in names], pa.int64()),
                        "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    }
                )

    kind = "doc_id long, text_md5 string, n_shingles long, set_hi long, set_lo long, bands array<long>"
    return with_row_id(text_rows(docs, id_col, text_col).withColumn("text_md5", F.md5("text")).mapInArrow(run, kind))


def full_sets(docs: DataFrame, wanted: DataFrame, reps: DataFrame, width: int, key: bytes, id_col: str, text_col: str) -> DataFrame:
    """rep, items: the whole sets of the representatives in ``wanted`` (column rep), read from the texts again."""
    named = reps.join(wanted.select("rep").distinct(), "rep").select("rep", F.col("doc_id").alias("rep_doc"), "set_hi", "set_lo")
    texts = text_rows(docs, id_col, text_col).join(named, F.col("doc_id").eqNullSafe(F.col("rep_doc"))).drop("rep_doc", "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("near_dedup")
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                names = list(zip(batch.column("set_hi").to_pylist(), batch.column("set_lo").to_pylist(), strict=True))
                # rows that share an id have other sets; only the representative's own set is taken
                out = [(i, s.tobytes()) for i, s in _sets(batch, width, key) if set_hashes(s) == names[i]]
                yield pa.RecordBatch.from_pydict(
                    {"rep": batch.column("rep").take(pa.array([i for i, _ in out], pa.int64())), "items": pa.array([s for _, s in out], pa.binary())}
                )

    full = texts.mapInArrow(sets, "rep long, items binary").groupBy("rep").agg(F.first("items").alias("items"))
    return stored(full, "sets")


def verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, width: int, key: bytes, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The links among ``pairs`` (a, b: representatives): estimated, then counted on the full sets."""
    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))
    full = full_sets(docs, ends, reps, width, key, id_col, text_col)
    both = pairs.join(full.select(F.col("rep").alias("a"), F.col("items").alias("items_a")), "a").join(
        full.select(F.col("rep").alias("b"), F.col("items").alias("items_b")), "b"
    )

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("near_dedup")
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("items_a"), batch.column("items_b"), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if linked(a, b, percent):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return stored(both.select("a", "b", "items_a", "items_b").mapInArrow(test, "a long, b long"), "verified")


def linked_across(
    docs: DataFrame, mixed: DataFrame, reps: DataFrame, width: int, secret: bytes, percent: int, block_bytes: int, id_col: str, text_col: str
) -> DataFrame:
    """Links across components inside bands: enough of them to join what is linked.

    ``mixed``: key, rep, component, n_shingles of all bands with several
    components. In each band the members outside its largest component meet
    all members. Members are dealt into blocks of at most ``block_bytes`` of
    sets on either side, and a task tests two blocks at a time, by counting
    common items of all sets at once. No row is made for a pair; a task returns
    a link only where it joins two components that it has not joined yet.
    """
    groups = mixed.groupBy("key", "component").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("items"))
    groups = groups.groupBy("key").agg(F.max(F.struct("rows", "component", "items")).alias("big"), F.sum("items").alias("items"))
    blocks = lambda items: F.greatest(F.lit(1), F.ceil(items * 8 / block_bytes)).cast("int")
    plan = groups.select(
        "key", F.col("big.component").alias("big"), blocks(F.col("items") - F.col("big.items")).alias("lefts"), blocks(F.col("items")).alias("rights")
    )
    rows = mixed.join(plan, "key")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ("key", "rep", "component")
    left = rows.where("component <> big").select(*columns, F.lit(0).alias("side"), own("lefts").alias("left"), every("rights").alias("right"))
    right = rows.select(*columns, F.lit(1).alias("side"), own("rights").alias("right"), every("lefts").alias("left"))
    sets = full_sets(docs, mixed, reps, width, secret, id_col, text_col)
    task = ("key", "left", "right")
    dealt = left.unionByName(right).join(sets, "rep").repartition(*task).sortWithinPartitions(*task, "side")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("near_dedup")
        now, sides = None, ([], [])
        for batch in batches:
            names = zip(*(batch.column(c).to_pylist() for c in (*task, "side", "rep", "component")), strict=True)
            for (*key, side, rep, component), items in zip(names, batch.column("items"), strict=True):
                if key != now:
                    yield _joining_links(*sides, percent)
                    now, sides = key, ([], [])
                sides[side].append((rep, component, np.frombuffer(items.as_buffer().to_pybytes(), U)))
        yield _joining_links(*sides, percent)

    return stored(dealt.select(*task, "side", "rep", "component", "items").mapInArrow(test, "a long, b long"), "across")


TILE = 256
COLUMNS = 8192


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many items any left and any right set share."""
    out = np.zeros((len(left), len(right)), np.int64)
    if len(left) * len(right) <= 4:
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                out[i, j] = len(np.intersect1d(a, b, assume_unique=True))
        return out
    known = np.unique(np.concatenate(left))

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        items, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(known, items), len(known) - 1)
        here = known[at] == items
        order = np.argsort(at[here], kind="stable")
        return row[here][order], at[here][order]

    (rows_l, at_l), (rows_r, at_r) = places(left), places(right)
    for start in range(0, len(known), COLUMNS):
        parts = []
        for rows, at, n in ((rows_l, at_l, len(left)), (rows_r, at_r, len(right))):
            a, b = np.searchsorted(at, (start, start + COLUMNS))
            m = np.zeros((n, min(COLUMNS, len(known) - start)), np.float32)
            m[rows[a:b], at[a:b] - start] = 1
            parts.append(m)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def _joining_links(left: list[tuple], right: list[tuple], percent: int) -> pa.RecordBatch:
    """Links between left and right members of different components that join components not yet joined here."""
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            parent[c] = parent.get(up, up)
            c = up
        return c

    a_out, b_out = [], []
    for x in range(0, len(left), TILE):
        for y in range(0, len(right), TILE):
            ls, rs = left[x : x + TILE], right[y : y + TILE]
            common = common_counts([s for _, _, s in ls], [s for _, _, s in rs])
            sizes = np.array([len(s) for _, _, s in ls])[:, None] + np.array([len(s) for _, _, s in rs])[None, :]
            apart = np.array([c for _, c, _ in ls])[:, None] != np.array([c for _, c, _ in rs])[None, :]
            for i, j in zip(*np.nonzero((100 * common >= percent * (sizes - common)) & apart), strict=True):
                p, q = root(ls[i][1]), root(rs[j][1])
                if p != q:
                    parent[p] = q
                    a_out.append(min(ls[i][0], rs[j][0]))
                    b_out.append(max(ls[i][0], rs[j][0]))
    return pa.RecordBatch.from_pydict({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * common >= percent * union, on sorted sets; the estimate spares the count where it is far off."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 100 * small < percent * large:
        return False
    power = powers_of(large)[0]
    if small > 64:
        spread = 6 * (0.25 / REGISTERS) ** 0.5
        if estimate(registers(a, power), registers(b, power), len(a), len(b), power) < percent / 100 - spread:
            return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def near_dedup(
    docs: DataFrame, width: int = 5, percent: int = 80, block_bytes: int = 1 << 25, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_md5, stays (the one row of the component that stays)."""
    key = new_key()
    signed = stored(signatures(docs, width, key, id_col, text_col), "signatures")
    name = ["set_hi", "set_lo", "n_shingles"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("first")
    classes = signed.where("n_shingles > 0").groupBy(*name).agg(first)
    classes = stored(classes.select(*name, F.col("first.row_id").alias("rep"), F.col("first.doc_id").alias("doc_id")), "classes")

    bands = signed.join(classes.select(F.col("rep").alias("row_id")), "row_id").select(F.explode("bands").alias("key"), F.col("row_id").alias("rep"))
    leaders = bands.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    shared = stored(bands.join(leaders, "key"), "shared-bands")

    votes = shared.where("rep <> leader").groupBy("rep", "leader").agg(F.count("*").alias("n"))
    best = votes.groupBy("rep").agg(F.max(F.struct("n", "leader")).alias("best"))
    pairs = stored(best.select(F.col("best.leader").alias("a"), F.col("rep").alias("b")), "first-pairs")
    links = verified(docs, pairs, classes, width, key, percent, id_col, text_col)
    found = components(links)

    named = shared.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component")
    )
    spread = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    mixed = named.join(spread, "key").join(classes.select("rep", "n_shingles"), "rep")
    more = linked_across(docs, stored(mixed, "mixed-bands"), classes, width, key, percent, block_bytes, id_col, text_col)
    found = components(links.unionByName(more))

    nodes = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        *name, F.coalesce("component", "rep").alias("component")
    )
    member = signed.select("row_id", "doc_id", "text_md5", *name).join(nodes, name, "left")
    # a document without a set is a component of its own
    member = stored(member.withColumn("component", F.coalesce("component", -1 - F.col("row_id"))), "members")
    least = member.groupBy("component").agg(
        F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("first")
    )
    return member.join(least, "component").select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "text_md5",
        (F.col("row_id") == F.col("first.row_id")).alias("stays"),
    )


def kept_documents(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with all its columns."""
    verdicts = near_dedup(docs, width, percent, id_col=id_col, text_col=text_col).select("doc_id", "text_md5", "stays")
    return rows_named(docs, verdicts, F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), id_col)
