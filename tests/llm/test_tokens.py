"""Token counts, byte-level codec and packing against the tokenizer libraries."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.brute import sha
from tests.llm.conftest import documents, edge_rows, prose, same_rows
from zonepulse.llm import bpe_codec, packing, token_counts


@pytest.fixture(scope="module")
def encoding():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_token_counts_equal_the_library(edge_docs):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, t in edge_rows():
        n = len(library.encode(t or "", add_special_tokens=False))
        want.append((i, len((t or "").encode()), n, n > 1024))
    # the caches and the broadcast table must not matter
    for options in ({}, {"table_size": 3, "per_task": 2, "cache_words": 5, "cache_pretokens": 2}):
        same_rows(token_counts.token_counts(edge_docs, **options).collect(), want)


def test_token_counts_of_an_empty_table(no_docs):
    found = token_counts.token_counts(no_docs)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and found.collect() == []


def test_texts_of_any_white_space_are_looked_up():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        blob = f.read()
    library = Tokenizer.from_str(blob)
    lengths = token_counts.Lengths(blob, P.PATTERN, {}, 100_000, 100_000)
    whole = []
    lengths.tokenizer = type("Watched", (), {"model": lengths.tokenizer.model, "encode": lambda self, text, **_: whole.append(text)})()
    rng = random.Random(4)
    marks = ["\n\n", "  ", "\t", " \n", "\r\n", "\u00a0", "\u2028", "\x85", "\u3000", " ", "'ll", "12", "!?", "漢字", "é́", *lengths.special]
    texts = ["", " a", "a ", "\n", *("".join(rng.choice([*marks, prose(n, 3)]) for _ in range(12)) for n in range(400))]
    assert [lengths.text(t) for t in texts] == [len(library.encode(t, add_special_tokens=False)) for t in texts]
    assert not whole and lengths.rare
    # white space inside a word must not make up for a word that is none
    assert token_counts.cut("a\n\u00a0 2\u20282", []) is None
    lengths.table = {" second": 5}
    assert lengths.text("first\n\n second") == lengths.pretoken("first") + lengths.pretoken("\n\n") + 5


def test_cut_refuses_what_the_pattern_joins():
    assert token_counts.cut("a b\nc d", []) == (["a", "c"], ["b", "d"])
    for text in ("", "a  b", " a", "a ", "a\n\nb", "a \nb", "a\tb", "a b", "a <s> b"):
        assert token_counts.cut(text, ["<s>"]) is None


@pytest.mark.parametrize("chunk", [32_768, 700])
def test_codec_equals_the_library_and_decodes(edge_docs, encoding, chunk):
    coded = bpe_codec.encode(edge_docs, chunk_chars=chunk, overlap=64 if chunk == 700 else 512)
    want = []
    for i, t in edge_rows():
        ids = encoding.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    same_rows(bpe_codec.digests(bpe_codec.decode(coded)).collect(), want)


def test_codec_of_an_empty_table(no_docs):
    assert bpe_codec.digests(bpe_codec.decode(bpe_codec.encode(no_docs))).collect() == []


def test_decode_keeps_null_ids(spark):
    coded = spark.createDataFrame([(1, None), (2, bytearray(b""))], "doc_id long, ids binary")
    assert [r["decoded"] for r in bpe_codec.decode(coded).orderBy("doc_id").collect()] == [None, b""]


def pieces_of(rows, capacity):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for n, s in enumerate(range(0, len(ids), capacity)):
            cut = ids[s : s + capacity]
            out.append((i, n, s, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    return out


def check_packing(got, want, capacity):
    same_rows([r[:5] for r in got], want)
    bins = {}
    for r in got:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def test_packing_of_edge_cases(edge_docs):
    found = packing.packed_documents(edge_docs, capacity=256, block_items=16).select(*COLUMNS).collect()
    check_packing([tuple(r) for r in found], pieces_of(edge_rows(), 256), 256)


def test_packing_fills_sequences(spark):
    rows = [(i, prose(i, 5 + 37 * i % 300)) for i in range(600)]
    found = packing.packed_documents(documents(spark, rows), capacity=512, block_items=128).select(*COLUMNS).collect()
    want = pieces_of(rows, 512)
    least = -(-sum(w[3] for w in want) // 512)
    assert least <= check_packing([tuple(r) for r in found], want, 512) <= 1.02 * least + 1


def test_packing_of_an_empty_table(no_docs):
    assert packing.packed_documents(no_docs).select(*COLUMNS).collect() == []


def test_crossover_keeps_every_piece_and_whole_bins():
    import random

    rng = random.Random(7)
    lengths = [rng.randint(1, 100) for _ in range(200)]
    a, b = packing.founder(lengths, 100, None), packing.founder(lengths, 100, rng)
    for _ in range(20):
        child = packing.crossover(a, b, lengths, 100, rng)
        assert sorted(i for c in child for i in c) == list(range(200))
        assert all(sum(lengths[i] for i in c) <= 100 for c in child)
        assert any(sorted(c) in [sorted(x) for x in a] for c in child)
        b = child


def test_evolution_never_loses_to_best_fit():
    import random

    rng = random.Random(3)
    lengths = [rng.randint(20, 60) for _ in range(300)]
    start = packing.founder(lengths, 100, None)
    grown = packing.evolve(lengths, [], 0, 0, 4, 30, 100)
    assert max(grown[0]) + 1 <= len(start)


def test_evolution_beats_best_fit_where_it_errs():
    import random

    rng = random.Random(1)
    thirds = []  # three to a sequence without a gap: 200 sequences are enough
    for _ in range(200):
        a = rng.randint(500, 900)
        b = rng.randint(500, 2048 - a - 400)
        thirds += [a, b, 2048 - a - b]
    rng.shuffle(thirds)
    pairs = [820] * 100 + [614] * 200  # best fit puts two of 820 together
    for lengths, least in ((thirds, 200), (pairs, 100)):
        alone = len(packing.founder(lengths, 2048, None))
        islands = [[], []]
        for epoch in range(2):
            islands = [packing.evolve(lengths, p, i, epoch, 3, 40, 2048) for i, p in enumerate(islands)]
            islands = [islands[0] + [islands[1][0]], islands[1] + [islands[0][0]]]
        assert least <= min(max(p[0]) + 1 for p in islands) < alone
        assert all(sum(lengths[i] for i in b) <= 2048 for b in packing.to_bins(islands[0][0]))


SCRIPTS = {
    "russian": "Кошка сидела на окне, и смотрела во двор; \"день\" был ясный. ",
    "greek": "Η γάτα καθόταν στο παράθυρο και κοίταζε έξω (όλη μέρα). ",
    "arabic": "جلست القطة على النافذة، ونظرت إلى الخارج طوال اليوم. ",
    "chinese": "猫坐在窗边，看着外面的院子。天气很好！",
    "japanese": "猫は窓辺に座って、外を見ていた。「いい天気だ」と言った。",
    "hindi": "बिल्ली खिड़की पर बैठी थी, और बाहर देख रही थी। ",
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_long_texts_of_any_script_are_cut(script):
    text = SCRIPTS[script] * 40
    cuts = bpe_codec.boundaries(text, P.PATTERN, 0, len(text), False)
    assert len(cuts) > 30
    import regex

    whole = regex.findall(P.PATTERN, text)
    for at in cuts:
        assert regex.findall(P.PATTERN, text[:at]) + regex.findall(P.PATTERN, text[at:]) == whole


def test_long_texts_of_any_script_are_encoded_as_a_whole(spark, encoding):
    texts = [s * 60 for s in SCRIPTS.values()] + ["ab'sé don't.'s x'S " * 90, "字" * 3000, "a. " * 900 + "\n\n" * 400]
    found = bpe_codec.encode(documents(spark, list(enumerate(texts))), chunk_chars=600, overlap=100).collect()
    assert {r["doc_id"]: bytes(r["ids"]) for r in found} == {i: np.array(encoding.encode_ordinary(t), "<u4").tobytes() for i, t in enumerate(texts)}
