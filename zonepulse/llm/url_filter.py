"""URL allow and block lists: a trie over reversed host labels, then path segments; the longest entry wins.

An entry is a host and a path prefix. It fits a URL on that host or any
subdomain of it whose path starts with the entry's path. The trie is walked
from the top-level label down; every host node that entries end at has a trie
over their paths' whole segments, whose nodes hold the beginnings of the next
segment. One walk meets all entries that fit, and the longest (host and path
together; of equal ones the one with the longer host) gives the verdict. If one
entry is both allowed and blocked, it blocks.

The trie is broadcast, and only up to ``most_entries`` entries and
``most_chars`` characters. Longer lists are dealt by a hash into blocks of that
size, each block is one more pass over (id, host, path, best entry so far), and
the longest over all blocks wins: the same result, with bounded memory.

Defined results: a null URL, or one without ``://``, has an empty host and path,
which no entry fits. An entry's host is lower-cased (A-Z) and may not be empty.
Repeated entries count once, repeated rows each. URLs may be of any length.
Without entries, or where none fits, the verdict is ``default``. An empty table
gives an empty result; columns besides those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.common import stored
from zonepulse.session import ship_package

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the contract.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

MATCHED = "page_id long, host string, path string, host_chars int, rule string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, CAPITALS, SMALL), path


class UrlTrie:
    """Entries by reversed host labels and path segments."""

    def __init__(self, entries: list[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in entries:
            self.add(verdict, host, path)

    def add(self, verdict: str, host: str, path: str) -> None:
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"not an entry: {verdict!r}, {host!r}, {path!r}")
        host = host.translate(str.maketrans(CAPITALS, SMALL))
        node = self.root
        for label in reversed(host.split(".")):
            node = node.setdefault("labels", {}).setdefault(label, {})
        node = node.setdefault("paths", {})
        *whole, begun = path.split("/")
        for segment in whole:
            node = node.setdefault("segments", {}).setdefault(segment, {})
        entry = (len(host) + len(path), len(host), host + path, verdict)
        ends = node.setdefault("begun", {})
        ends[begun] = max(ends.get(begun, entry), entry)  # "block" is greater than "allow"
        node["sizes"] = sorted({len(x) for x in ends})

    def fitting(self, host: str, path: str) -> Iterator[tuple[int, int, str, str]]:
        """Every entry that fits, as (characters, characters of the host, entry, verdict)."""
        segments: list[str] | None = None
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                return
            if "paths" in node:
                segments = path.split("/") if segments is None else segments
                at = node["paths"]
                for segment in segments:
                    for size in at.get("sizes", ()):
                        if size > len(segment):
                            break
                        if (found := at["begun"].get(segment[:size])) is not None:
                            yield found
                    at = at.get("segments", {}).get(segment)
                    if at is None:
                        break

    def longest(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        return max(self.fitting(host, path), default=None)


def _pass(rows: DataFrame, entries: list[tuple[str, str, str]]) -> DataFrame:
    """``rows`` with the longest entry of one block, where it beats the one they have."""
    trie = rows.sparkSession.sparkContext.broadcast(UrlTrie(entries))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            sizes, rules, verdicts = [], [], []
            have = zip(*(columns[c].to_pylist() for c in ("host", "path", "host_chars", "rule", "verdict")), strict=True)
            for host, path, host_chars, rule, verdict in have:
                best = trie.value.longest(host, path)
                if best is None or rule is not None and (len(rule), host_chars) >= best[:2]:
                    best = (0, host_chars, rule, verdict)
                sizes.append(best[1])
                rules.append(best[2])
                verdicts.append(best[3])
            yield pa.RecordBatch.from_arrays(
                [columns["page_id"], columns["host"], columns["path"], pa.array(sizes, pa.int32()), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                names=["page_id", "host", "path", "host_chars", "rule", "verdict"],
            )

    return rows.mapInArrow(match, MATCHED)


def _blocks(rules: DataFrame, most_entries: int, most_chars: int) -> Iterator[list[tuple[str, str, str]]]:
    """The entries in blocks of bounded size, dealt by a hash (half full on average, so that none overflows)."""
    entries = rules.select(
        F.col("verdict").cast("string"), F.translate(F.col("host").cast("string"), CAPITALS, SMALL).alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path")
    ).distinct()
    n, chars = entries.agg(F.count("*"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0))).first()
    blocks = max(1, -(-2 * n // most_entries), -(-2 * chars // most_chars)) if n > most_entries or chars > most_chars else 1
    if blocks > 1:
        entries = stored(entries.withColumn("block", F.pmod(F.xxhash64("host", "path"), F.lit(blocks))), "rules")
    for k in range(blocks):
        own = entries.where(F.col("block") == k).drop("block") if blocks > 1 else entries
        found = own.limit(most_entries + 1).collect()
        if len(found) > most_entries:
            raise ValueError(f"a block of more than {most_entries} entries; raise the number of blocks")
        yield [tuple(x) for x in found]


def judge(
    pages: DataFrame,
    rules: DataFrame | list[tuple[str, str, str]],
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    most_entries: int = 200_000,
    most_chars: int = 16_000_000,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row; see the module's docstring.

    ``rules`` is a list of (verdict, host, path), or a frame with these columns.
    ``default`` is the verdict where no entry fits.
    """
    if default not in ("allow", "block"):
        raise ValueError(f"not a verdict: {default!r}")
    spark = pages.sparkSession
    ship_package(spark)
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", F.lit(0).alias("host_chars"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    if isinstance(rules, list):
        rules = spark.createDataFrame(rules, "verdict string, host string, path string")
    for k, entries in enumerate(_blocks(rules, most_entries, most_chars)):
        rows = _pass(rows if k == 0 else stored(rows, "judged"), entries)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
