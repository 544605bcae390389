"""Names of words: different words stay apart, in op1 and op9 too, and very long texts are read whole."""

import numpy as np
import pytest

from tests.llm import brute
from tests.llm.conftest import documents, edge_rows, prose, same_rows
from zonepulse.llm import hashing, near_dedup, substring_dedup


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (256, 512, 1024, 2048, 4096)]


def names(text, key=b"k" * 16, fold=False):
    return hashing.named_words(np.frombuffer(text.encode(), np.uint8), key, fold)[0].tolist()


def test_equal_words_have_equal_names_and_others_do_not():
    text = prose(3, 4000) + " a a\x00 \x00 \x00\x00 abcdefg abcdefgh abcdefg\x00 é éé " + " ".join(x for pair in PAIRS for x in pair)
    found = dict.fromkeys(zip(brute.words(text), names(text), strict=True))
    assert len(found) == len({w for w, _ in found}) == len({n for _, n in found})
    assert names(text, b"other key, other") != names(text)


def test_folding_takes_only_ascii_letters():
    assert names("ABC Éa LONGERWORD x" * 2, fold=True) == names("abc Éa longerword x" * 2, fold=True)
    assert names("É")[0] != names("é")[0] and names("É", fold=True)[0] != names("é", fold=True)[0]


def test_names_do_not_depend_on_segments():
    text = prose(8, 500) + " " + "y" * 300 + " end"
    whole = names(text)
    before, hashing.SEGMENT = hashing.SEGMENT, 64
    try:
        assert names(text) == whole
    finally:
        hashing.SEGMENT = before


def test_words_of_every_length_have_their_own_names():
    words = {prose(n, 40).replace(" ", "")[:n] for n in range(1, 90)}
    words |= {w[:k] + "#" + w[k + 1 :] for w in list(words) for k in range(len(w))} | {w + "\x00" for w in words}
    text = " ".join(sorted(words)) + "x"  # the last word ends at the end of the text
    assert len(set(names(text))) == len(set(brute.words(text)))
    assert names(text[:-1])[:-1] == names(text)[:-1]
    assert names(text + " " + text) == names(text) * 2


def colliding_rows():
    rows = []
    for k, (a, b) in enumerate(PAIRS):
        rows += [(10 * k, "q " * 19 + a), (10 * k + 1, "q " * 19 + b), (10 * k + 2, a), (10 * k + 3, b), (10 * k + 4, f"{a} {b} {a}"), (10 * k + 5, f"{b} {a} {b}")]
    return rows


def test_words_made_to_collide_in_substring_dedup(spark):
    rows = colliding_rows()
    found = substring_dedup.substring_dedup(documents(spark, rows))
    same_rows(found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), brute.substring_dedup(rows, 20))
    assert found.where("n_removed > 0").count() == 0


@pytest.mark.parametrize("width", [1, 2])
def test_words_made_to_collide_in_near_dedup(spark, width):
    rows = colliding_rows()
    found = near_dedup.near_dedup(documents(spark, rows), width=width)
    same_rows(found.select("doc_id", "n_shingles", "component_id").collect(), brute.near_components(rows, width, 80))


def long_rows():
    long = prose(40, 120_000)
    half = " ".join(long.split()[50_000:90_000])
    return edge_rows() + [(50, long), (51, half), (52, long + " and more"), (53, "z" * 300_000), (54, "z" * 300_000 + "y")]


def test_very_long_texts_in_substring_dedup(spark):
    rows = long_rows()
    found = substring_dedup.substring_dedup(documents(spark, rows))
    same_rows(found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), brute.substring_dedup(rows, 20))


def test_very_long_texts_in_near_dedup(spark):
    rows = long_rows()
    found = near_dedup.near_dedup(documents(spark, rows), width=2)
    same_rows(found.select("doc_id", "n_shingles", "component_id").collect(), brute.near_components(rows, 2, 80))
