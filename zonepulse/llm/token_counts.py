"""Token counts by a two-tier lookup on the map side.

First pass: every task counts its pre-tokens in one bounded table and hands
over its most frequent ones; their sums are added up (a few thousand rows a
task, no shuffle of pre-tokens) and the most frequent of all are encoded once.
Their lengths in tokens are broadcast as one compact hash table of at most
``table_size`` entries (32,768, under 2 MB), whatever the size of the corpus.

Second pass: texts are cut at plain spaces and line ends, where pre-tokens
always end, and the pieces looked up in a bounded cache of the worker; what it
lacks is cut into pre-tokens and looked up in the broadcast table, then in the
worker's pre-token cache, and only then encoded by the tokenizer library.
Counts do not depend on the table or the caches; they save time only.

Texts with other white space, or that hold one of the tokenizer's special
strings, are cut at those strings and by the pre-token pattern itself; their
pre-tokens are looked up in the same table and cache. Only texts that hold one
of the four separators U+001C to U+001F (white space to Python alone), and all
such texts of a tokenizer that is not plainly byte-level or whose special
strings take in their surroundings, are encoded whole by the library.

Defined results. Null and empty texts: 0 bytes, 0 tokens. Repeated rows are
counted each. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.common import text_rows, worker_state

def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: visible Latin-1 ones for themselves, the others from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


#: White space to Python's patterns, but not to the library's.
SEPARATORS = re.compile("[\x1c-\x1f]")
TO_CHARACTERS = dict(enumerate(byte_characters()))


class Lengths:
    """Token counts of pre-tokens and of words, in the library's own terms, with caches of bounded size.

    ``table`` holds the frequent pre-tokens (broadcast), ``rare`` those that
    this worker met, ``inner`` and ``heads`` whole words after a space and
    without one. All are look-ups only: a full cache is emptied.
    """

    def __init__(self, blob: str, pattern: str, table: dict[str, int], words: int, pretokens: int):
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(blob)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parts = json.loads(blob)
        self.special = [t["content"] for t in parts.get("added_tokens") or []]
        before = parts.get("pre_tokenizer") or {}
        #: bytes stand for characters and nothing else happens before the merges: ask the merges directly
        self.plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and not parts.get("normalizer")
        added = parts.get("added_tokens") or []
        #: special strings stand for one token each, the longest first, and take in nothing around them
        self.alone = not any(t.get(f) for t in added for f in ("lstrip", "rstrip", "single_word"))
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))).split if self.special else lambda t: [t]
        self.find = regex.compile(pattern).findall
        self.table, self.rare, self.most_words, self.most_rare = table, {}, words, pretokens
        self.inner, self.heads = Words(self, " "), Words(self, "")

    def encode(self, pretoken: str) -> int:
        if self.plain:
            return len(self.tokenizer.model.tokenize(pretoken.encode().decode("latin-1").translate(TO_CHARACTERS)))
        return len(self.tokenizer.encode(pretoken, add_special_tokens=False))

    def pretoken(self, text: str) -> int:
        n = self.table.get(text)
        if n is None:
            n = self.rare.get(text)
            if n is None:
                if len(self.rare) >= self.most_rare:
                    self.rare.clear()
                n = self.rare[text] = self.encode(text)
        return n

    def pretokens(self, text: str) -> list[str]:
        # letters alone, after a space or not, are one pre-token
        return [text] if text.lstrip(" ").isalpha() else self.find(text)

    def pieces(self, text: str) -> tuple[int, list[str]] | None:
        """How many special strings any text holds, and the pre-tokens between them; None if only the library can tell."""
        if not (self.plain and self.alone) or SEPARATORS.search(text):
            return None
        parts = self.split(text)
        found = [p for part in parts for p in self.find(part)]
        if sum(map(len, found)) != sum(map(len, parts)):
            return None  # the pattern leaves something out
        return len(parts) - 1, found

    def text(self, text: str) -> int:
        words = cut(text, self.special)
        if words is None:
            pieces = self.pieces(text)
            if pieces is None:
                return len(self.tokenizer.encode(text, add_special_tokens=False))
            return pieces[0] + sum(map(self.pretoken, pieces[1]))
        heads, inner = words
        line_ends = (len(heads) - 1) * self.pretoken("\n") if len(heads) > 1 else 0
        return line_ends + sum(map(self.heads.__getitem__, heads)) + sum(map(self.inner.__getitem__, inner))


class Words(dict):
    """Tokens of a word behind ``before``, worked out when first asked for."""

    def __init__(self, lengths: Lengths, before: str):
        super().__init__()
        self.lengths, self.before = lengths, before

    def __missing__(self, word: str) -> int:
        if len(self) >= self.lengths.most_words:
            self.clear()
        n = self[word] = sum(map(self.lengths.pretoken, self.lengths.pretokens(self.before + word)))
        return n


def cut(text: str, special: list[str]) -> tuple[list[str], list[str]] | None:
    """The first words of the lines and all other words, if pre-tokens must end around each line end and before each space.

    That is so where white space is single spaces and line ends between other
    characters. None for other texts, empty ones and ones with a special string.
    """
    heads, inner = [], []
    for line in text.split("\n"):
        words = line.split(" ")
        heads.append(words[0])
        inner += words[1:]
    if "" in heads or "" in inner or text.split() != text.replace("\n", " ").split(" ") or any(s in text for s in special):
        return None
    return heads, inner


def worker_lengths(shared, pattern: str, words: int, pretokens: int) -> Lengths:
    """The worker's caches, kept from task to task."""
    state = worker_state(shared.value["key"])
    if "lengths" not in state:
        state["lengths"] = Lengths(shared.value["blob"], pattern, shared.value["table"], words, pretokens)
    return state["lengths"]


def frequent_pretokens(docs: DataFrame, shared, pattern: str, table_size: int, per_task: int) -> list[str]:
    """The most frequent pre-tokens of the corpus by the tasks' own heaviest counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(shared.value["blob"], pattern, {}, 0, 0)
        found: Counter = Counter()

        def settle(inner: Counter, others: Counter) -> None:
            for word, n in inner.items():
                if n > 1:  # what a stretch of text holds once is not frequent
                    for pretoken in lengths.pretokens(" " + word):
                        found[pretoken] += n
            for pretoken, n in others.items():
                if n > 1:
                    found[pretoken] += n
            if len(found) > 40 * per_task:  # keep the heaviest, as in frequent-item summaries
                keep = found.most_common(10 * per_task)
                found.clear()
                found.update(dict(keep))

        for batch in batches:
            local: Counter = Counter()
            others: Counter = Counter()
            for value in batch.column("text"):
                text = value.as_py()
                words = cut(text, lengths.special)
                if words is not None:
                    local.update(words[1])
                else:
                    pieces = lengths.pieces(text)
                    if pieces is not None:
                        others.update(pieces[1])
                if len(local) + len(others) > 30_000:  # small counters stay in the processor's caches
                    settle(local, others)
                    local, others = Counter(), Counter()
            settle(local, others)
        top = found.most_common(per_task)
        yield pa.RecordBatch.from_pydict(
            {"pretoken": pa.array([t for t, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())}
        )

    counted = docs.select("text").mapInArrow(count, "pretoken string, n long")
    top = counted.groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(table_size)
    return [r["pretoken"] for r in top.collect()]


def token_counts(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    pattern: str = public_tokenizers.PATTERN,
    table_size: int = 32_768,
    per_task: int = 8_192,
    cache_words: int = 300_000,
    cache_pretokens: int = 500_000,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``pattern`` must be the tokenizer's own split of texts into pre-tokens.
    """
    with open(tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        blob = f.read()
    sc = docs.sparkSession.sparkContext
    rows = text_rows(docs, id_col, text_col)
    frequent = frequent_pretokens(rows, sc.broadcast({"blob": blob}), pattern, table_size, per_task)
    own = Lengths(blob, pattern, {}, 0, 0)
    table = {p: own.encode(p) for p in frequent}
    shared = sc.broadcast({"key": uuid.uuid4().hex, "blob": blob, "table": table})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = worker_lengths(shared, pattern, cache_words, cache_pretokens)
        for batch in batches:
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.compute.binary_length(batch.column("text")).cast(pa.int64()),
                    "n_tokens": pa.array([lengths.text(t.as_py()) for t in batch.column("text")], pa.int64()),
                }
            )

    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
