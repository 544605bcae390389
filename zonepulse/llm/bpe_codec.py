"""Byte-level BPE encoding and decoding with overlapping chunks.

Texts of up to ``chunk_chars`` characters are one chunk and are encoded where
they lie. Longer texts are cut into chunks that reach ``overlap`` characters
into their successor. Chunks are dealt out and pre-tokenised in parallel, each
from its own start, which may lie inside a pre-token. The splitting pattern
looks at most three characters ahead, so two neighbours fall in step soon after
the later one's start; the first boundary that both have in the overlap is the
cut. A cut must also stand behind a letter or digit of any script and before
either one plain space and a letter or digit, or a mark other than an
apostrophe: the runs of the splitting pattern end there whatever lies around.
Where neighbours have no such boundary in common, their chunks are joined. The pieces between cuts
are encoded by the tiktoken library and put in order again; decoding joins
the bytes of the ids.

Defined results. Null text is empty: no ids. Repeated rows are encoded each.
An empty table gives an empty result. Extra columns are not read. Special
strings are ordinary text.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonepulse.llm.common import stored, text_rows, with_row_id, worker_state

SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?= [\p{L}\p{N}]|[^\s\p{L}\p{N}'])")

#: Kinds of characters as of Unicode 3.2: what was a letter or a mark then is one to every library since.
KINDS = unicodedata.ucd_3_2_0.category


def safe_cut(text: str, at: int) -> bool:
    """Whether all libraries agree on the characters around a place that SAFE matches."""
    return KINDS(text[at - 1])[0] in "LN" and (KINDS(text[at + 1])[0] in "LN" if text[at] == " " else KINDS(text[at])[0] in "PS")


def encoding_of(blob: bytes, pattern: str):
    """The worker's encoding, made once per process."""
    import tiktoken

    state = worker_state(f"codec {hash(blob)} {pattern}")
    if "encoding" not in state:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}
        state["encoding"] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return state["encoding"]


def boundaries(text: str, pattern: str, start: int, stop: int, whole: bool) -> list[int]:
    """Starts of pre-tokens in [start, stop) that are also safe to cut at; the last three characters of a cut text count for nothing."""
    stop = min(stop, len(text) + 1 if whole else len(text) - 3)
    safe = {m.start() for m in SAFE.finditer(text, max(0, start), min(len(text), stop + 2)) if safe_cut(text, m.start())}
    found = []
    for m in regex.finditer(pattern, text):
        if m.start() >= stop:
            break
        if m.start() >= start and m.start() in safe:
            found.append(m.start())
    return found


def encode(
    docs: DataFrame,
    ranks_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    pattern: str = public_tokenizers.PATTERN,
    chunk_chars: int = 16_384,
    overlap: int = 512,
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encoding.encode_ordinary(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict(
                    {c: part.column(c) for c in part.schema.names if c != "text"}
                    | {
                        "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                        "ids": pa.array([np.array(x, "<u4").tobytes() for x in ids], pa.binary()),
                    }
                )

    rows = text_rows(docs, id_col, text_col)
    short = rows.where(F.length("text") <= chunk_chars).mapInArrow(run, "doc_id long, n_tokens long, ids binary")
    long = stored(with_row_id(rows.where(F.length("text") > chunk_chars)), "long-texts")
    joined = _long_texts(long, run, pattern, chunk_chars, overlap)
    return short.unionByName(joined)


def _long_texts(long: DataFrame, run, pattern: str, chunk_chars: int, overlap: int) -> DataFrame:
    """Chunk, find boundaries, cut, encode and join the long texts."""
    n = long.sparkSession.conf.get("spark.sql.shuffle.partitions")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                for at in range(0, len(text), 256 * chunk_chars):
                    starts = range(at, min(len(text), at + 256 * chunk_chars), chunk_chars)
                    of = pa.array([i] * len(starts))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "row_id": batch.column("row_id").take(of),
                            "doc_id": batch.column("doc_id").take(of),
                            "chunk": pa.array([k // chunk_chars for k in starts], pa.int32()),
                            "text": pa.array([text[k : k + chunk_chars + overlap] for k in starts], pa.string()),
                        }
                    )

    chunks = long.select("row_id", "doc_id", "text").mapInArrow(deal, "row_id long, doc_id long, chunk int, text string")
    chunks = chunks.repartition(int(n), "row_id", "chunk")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            head = [boundaries(t, pattern, 0, overlap, False) for t in texts]
            tail = [[b - chunk_chars for b in boundaries(t, pattern, chunk_chars, len(t), False)] for t in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "row_id": batch.column("row_id"),
                    "doc_id": batch.column("doc_id"),
                    "chunk": batch.column("chunk"),
                    "text": pa.array([t[:chunk_chars] for t in texts], pa.string()),
                    "head": pa.array(head, pa.list_(pa.int32())),
                    "tail": pa.array(tail, pa.list_(pa.int32())),
                }
            )

    found = chunks.mapInArrow(split, "row_id long, doc_id long, chunk int, text string, head array<int>, tail array<int>")
    order = Window.partitionBy("row_id").orderBy("chunk")
    cut = found.withColumn("cut", F.array_min(F.array_intersect("head", F.lag("tail").over(order)))).withColumn(
        "piece", F.count("cut").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    whole = F.struct("piece", F.lit(0).alias("half"), "text")
    before = F.struct((F.col("piece") - 1).alias("piece"), F.lit(0).alias("half"), F.expr("substring(text, 1, cut)").alias("text"))
    after = F.struct("piece", F.lit(1).alias("half"), F.expr("substring(text, cut + 1)").alias("text"))
    kind = "array<struct<piece:long,half:int,text:string>>"
    parts = cut.select(
        "row_id",
        "doc_id",
        "chunk",
        F.explode(F.when(F.col("cut").isNull(), F.array(whole).cast(kind)).otherwise(F.array(before, after).cast(kind))).alias("part"),
    )
    by = F.sort_array(F.collect_list(F.struct("chunk", "part.half", F.col("part.text").alias("text"))))
    pieces = parts.groupBy("row_id", "part.piece").agg(F.first("doc_id").alias("doc_id"), by.alias("texts"))
    pieces = pieces.select("row_id", "doc_id", "piece", F.array_join("texts.text", "").alias("text"))
    coded = pieces.mapInArrow(run, "row_id long, doc_id long, piece long, n_tokens long, ids binary")
    in_order = F.sort_array(F.collect_list(F.struct("piece", "ids")))
    whole_docs = coded.groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), in_order.alias("parts")
    )
    joined = F.unhex(F.array_join(F.transform("parts.ids", F.hex), ""))  # linear in the length
    return whole_docs.select("doc_id", "n_tokens", joined.alias("ids"))


def decode(coded: DataFrame, ranks_path: str | None = None, ids_col: str = "ids", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``coded`` with a column decoded: the bytes of its ids, joined; null ids give null."""
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        shared = coded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [None if x is None else np.frombuffer(x, "<u4").tolist() for x in part.column(ids_col).to_pylist()]
                decoded = pa.array([None if x is None else encoding.decode_bytes(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], [*part.schema.names, "decoded"])

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )

