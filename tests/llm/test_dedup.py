"""Exact, near and substring duplicates against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import documents, edge_rows, prose, same_rows
from zonepulse.llm import exact_dedup, near_dedup, substring_dedup, suffix_dedup
from zonepulse.llm.common import STORED
from zonepulse.llm.components import components
from zonepulse.llm.hashing import shingle_set, sliding_argmin, words_of


def short_edge_rows():
    """The long texts cut, for the quadratic versions."""
    return [(i, t[:4000] if t else t) for i, t in edge_rows()]


def planted_rows(n=60):
    """Texts with copies, near copies and passages that several share."""
    rng = random.Random(11)
    passages = [prose(100 + p, rng.randint(20, 90)) for p in range(5)]
    rows = []
    for i in range(n):
        text = prose(i, rng.randint(3, 120), words=3000)
        if rng.random() < 0.5:
            text += " " + rng.choice(passages) + " " + prose(i + 1000, 8, words=3000)
        if rows and rng.random() < 0.3:
            source = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 3)):
                source[rng.randrange(len(source))] = "edit"
            text = " ".join(source)
        rows.append((i, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [edge_rows(), planted_rows()], ids=["edge", "planted"])
def test_exact_dedup(spark, rows):
    found = exact_dedup.exact_dedup(documents(spark, rows)).collect()
    groups = brute.exact_groups(rows)
    assert len(found) == len(rows)
    same_rows(
        [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found],
        [(i, groups[k][0], len(groups[k]), brute.sha(k.encode())) for i, t in rows for k in [brute.normalised(t)]],
    )
    kept = [(r["doc_id"], r["text_sha256"]) for r in found if r["kept"]]
    same_rows(kept, [(ids[0], brute.sha(k.encode())) for k, ids in groups.items()])


def test_exact_dedup_of_an_empty_table(no_docs):
    assert exact_dedup.exact_dedup(no_docs).collect() == []
    assert exact_dedup.kept_documents(no_docs).columns == no_docs.columns


def test_exact_dedup_refuses_a_hash_that_clashes(edge_docs):
    with pytest.raises(ValueError, match="chunk names"):
        exact_dedup.exact_dedup(edge_docs, name=lambda c: F.substring(F.hex(F.length(c)), 1, 1).cast("binary"))


def test_equal_stretches_give_equal_chunks(spark):
    text = prose(9, 2000)
    frame = spark.createDataFrame([(text,), ("Another start. " + text,)], "norm string")
    one, two = (set(r[0]) for r in frame.select(exact_dedup.chunk_list(F.col("norm"))).collect())
    assert len(one & two) >= len(one) - 2


@pytest.mark.parametrize(
    ("letters", "between"),
    [("ABDEILNORST", " "), ("0123456789", ""), ("абвгдежиклмнопрсту", " "), ("".join(map(chr, range(0x4E00, 0x4F00))), ""), ("אבגדהולמנרת", " "), ("abcdefghij", "")],
    ids=["capitals", "digits", "cyrillic", "han", "hebrew", "lower case without spaces"],
)
def test_equal_stretches_of_any_script_give_equal_chunks(spark, letters, between):
    rng = random.Random(4)
    text = between.join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(5000))
    frame = spark.createDataFrame([(text,), ("1" + letters[3] + text,)], "norm string")
    one, two = (r[0] for r in frame.select(exact_dedup.chunk_list(F.col("norm"))).collect())
    assert "".join(one) == text and all(1 <= len(c) <= 4096 for c in one)
    assert len(set(one) & set(two)) >= len(set(one)) - 3 and len(one) > 10


def family_rows(n=90):
    """Copies of one text with other edits each: some linked with each other, some with none."""
    rng = random.Random(3)
    base = prose(77, 80, words=4000).split()
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(len(words)), 2 + i % 9):
            words[at] = f"w{rng.random()}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(
    ("rows", "width", "block_bytes"),
    [
        (short_edge_rows(), 2, 1 << 25),
        (short_edge_rows(), 5, 4000),
        (planted_rows(), 2, 1 << 25),
        (planted_rows(), 5, 4000),
        (family_rows(), 2, 4000),
        (family_rows(), 2, 1 << 25),
    ],
    ids=["edge-2", "edge-5-blocks", "planted-2", "planted-5-blocks", "family-2-blocks", "family-2"],
)
def test_near_dedup(spark, rows, width, block_bytes):
    found = near_dedup.near_dedup(documents(spark, rows), width=width, percent=80, block_bytes=block_bytes)
    same_rows(found.select("doc_id", "n_shingles", "component_id").collect(), brute.near_components(rows, width, 80))
    assert found.where("kept <> (doc_id <=> component_id)").count() == 0


def test_near_dedup_keeps_one_row_of_each_component(spark):
    rows = planted_rows()
    docs = documents(spark, rows)
    kept = near_dedup.kept_documents(docs, width=2)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute.near_components(rows, 2, 80)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_near_dedup_of_an_empty_table(no_docs):
    assert near_dedup.near_dedup(no_docs).collect() == []


def sets_of_similarity(rng, size, similarity):
    shared = round(2 * size * similarity / (1 + similarity))
    draw = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    common = draw(shared)
    return np.unique(np.concatenate([common, draw(size - shared)])), np.unique(np.concatenate([common, draw(size - shared)]))


@pytest.mark.parametrize("size", [5, 12, 40, 150, 700, 3000, 20000])
def test_bands_find_and_registers_estimate(size):
    rng = np.random.default_rng(size)
    missed, errors = 0, []
    for _ in range(60 if size < 5000 else 12):
        a, b = sets_of_similarity(rng, size, 0.82)
        keys = [np.concatenate([near_dedup.band_keys(near_dedup.registers(s, p), p) for p in near_dedup.powers_of(len(s))]) for s in (a, b)]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        if true >= 0.8:
            missed += not len(np.intersect1d(*keys))
            power = near_dedup.powers_of(max(len(a), len(b)))[0]
            ra, rb = near_dedup.registers(a, power), near_dedup.registers(b, power)
            errors.append(near_dedup.estimate(ra, rb, len(a), len(b), power) - true)
    assert missed == 0
    assert not errors or abs(np.mean(errors)) < 0.04 and max(map(abs, errors)) < 0.2


def test_common_counts_of_many_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(1, 900)).astype(np.uint64)) for _ in range(12)]
    before, near_dedup.COLUMNS = near_dedup.COLUMNS, 500
    try:
        found = near_dedup.common_counts(sets[:5], sets)
    finally:
        near_dedup.COLUMNS = before
    assert found.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:5]]


def test_unrelated_sets_are_estimated_near_zero():
    rng = np.random.default_rng(5)
    a, b = sets_of_similarity(rng, 50_000, 0.0)
    found = near_dedup.estimate(near_dedup.registers(a, 15), near_dedup.registers(b, 15), len(a), len(b), 15)
    assert found < 0.05


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def test_components_of_long_chains_in_any_order(spark):
    far = [*range(1, 1000), 0]
    shuffled = random.Random(1).sample(range(1000, 2000), 1000)
    versions = random.Random(2).sample(range(2000, 3000), 1000)  # each linked to its next four
    links = [*zip(far, far[1:]), *zip(shuffled, shuffled[1:]), *((versions[i], b) for i in range(999) for b in versions[i + 1 : i + 5])]
    before = len(STORED)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: n // 1000 * 1000 for n in range(3000)}
    assert len(STORED) - before <= 25  # a table of labels a round


@pytest.mark.parametrize("rows", [short_edge_rows(), planted_rows()], ids=["edge", "planted"])
@pytest.mark.parametrize(("length", "seed"), [(20, 6), (7, 3)])
def test_substring_dedup(spark, rows, length, seed):
    found = substring_dedup.substring_dedup(documents(spark, rows), length=length, seed=seed)
    want = brute.substring_dedup(rows, length)
    same_rows(found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), want)
    assert any(w[2] for w in want)


def test_substring_dedup_keeps_the_texts(spark):
    a = " ".join(f"w{i}" for i in range(30))
    found = substring_dedup.substring_dedup(documents(spark, [(1, a + " x"), (2, "y " + a + " z")])).orderBy("doc_id").collect()
    assert [r["text"] for r in found] == [a + " x", "y z"]
    assert [r["n_repeats"] for r in found] == [0, 1]


def test_substring_dedup_of_an_empty_table(no_docs):
    assert substring_dedup.substring_dedup(no_docs).collect() == []


@pytest.mark.parametrize("rows", [short_edge_rows(), planted_rows()], ids=["edge", "planted"])
@pytest.mark.parametrize("options", [{}, {"length": 40, "seed": 8}, {"length": 60, "seed": 16, "most_contexts": 1}, {"length": 40, "seed": 4, "block_bytes": 1}])
def test_suffix_dedup(spark, rows, options):
    found = suffix_dedup.digests(suffix_dedup.suffix_dedup(documents(spark, rows), **options))
    want = brute.suffix_dedup(rows, options.get("length", 200))
    same_rows(found.collect(), want)
    assert any(w[2] for w in want)


def test_suffix_dedup_keeps_documents_and_columns(spark):
    rows = planted_rows()
    docs = documents(spark, rows)
    kept = suffix_dedup.kept_documents(docs, length=60, seed=16)
    assert kept.columns == docs.columns
    want = brute.suffix_dedup(rows, 60)
    same_rows([(r["doc_id"], brute.sha(r["text"].encode())) for r in kept.collect()], [(w[0], w[4]) for w in want])


def test_suffix_dedup_of_an_empty_table(no_docs):
    assert suffix_dedup.suffix_dedup(no_docs).collect() == []
    assert suffix_dedup.kept_documents(no_docs).collect() == []


def test_suffix_dedup_checks_its_arguments(no_docs):
    with pytest.raises(ValueError, match="length"):
        suffix_dedup.suffix_dedup(no_docs, length=20)


def test_cover_ranks_resolve_ties_between_remainders():
    rng = np.random.default_rng(2)
    piece = rng.integers(97, 99, 80, dtype=np.uint8)
    parts, starts = [], []
    for gap in range(30):  # the same bytes at all remainders, and some that differ in one place
        parts.append(rng.integers(97, 123, gap, dtype=np.uint8))
        starts.append(sum(map(len, parts)))
        other = piece.copy()
        if gap % 3 == 0:
            other[gap + 20] ^= 1
        parts.append(other)
    data, starts = np.concatenate(parts), np.array(starts)
    found = suffix_dedup.repeated_starts(data, starts, np.zeros(30, np.int64), 80)
    content = [bytes(data[s : s + 80]) for s in starts]
    assert found.tolist() == [content.count(c) > 1 for c in content]


def test_long_texts_hash_like_short_ones():
    data = np.frombuffer(prose(8, 500).encode(), np.uint8)
    import zonepulse.llm.hashing as h

    whole = words_of(data)
    before, h.SEGMENT = h.SEGMENT, 64
    try:
        parts = words_of(data)
    finally:
        h.SEGMENT = before
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert len(shingle_set(whole[0], 1)) == len(set(bytes(data).split()))


@pytest.mark.parametrize("width", [1, 2, 3, 7, 16])
def test_sliding_argmin(width):
    keys = np.random.default_rng(width).integers(0, 6, 200, dtype=np.uint64) << np.uint64(40)
    want = [s + int(np.argmin(keys[s : s + width])) for s in range(200 - width + 1)]
    assert sliding_argmin(keys, width).tolist() == want
