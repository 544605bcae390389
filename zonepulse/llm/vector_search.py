"""Exact top-k search by inner product as a Voronoi join.

A bounded set of pivots (``n_pivots`` rows, the smallest hashes) is broadcast;
every vector goes to the cell of its nearest pivot. A summary of each cell (its
size, radius and largest norm; one row a cell) is broadcast too.

1. Each query is solved in its own cell. Its k-th best score there is a floor.
2. For any other cell with pivot p, radius r and largest norm m, no score can
   exceed min(q.p + |q| r, |q| m). Queries are sent only to the cells whose
   bound reaches their floor; all other cells are left out, exactly.
3. The best k of both rounds are merged.

Queries are sent to the data, as there are fewer of them. A cell is split into
chunks of about ``chunk_rows`` rows and its queries into blocks of about
``block_queries``, so that a cell with a third of all rows (copies of one
vector) becomes many tasks of bounded size.

Defined results. Rows with a null vector, or with null or non-finite
components, take no part. Vectors of different lengths are compared as if
padded with zeros; an empty vector scores 0. Repeated rows are candidates each;
only a query's own row is left out. Ties go to the smaller vec_id (null last).
With no valid rows the result is empty. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonepulse.llm.common import stored, with_row_id, worker_state

EXACT = float(2**53)


def matrix(column, width: int) -> np.ndarray:
    """A list column as int64 rows, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, np.arange(len(flat)) - starts] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; in doubles where that is exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


LAST_ID = np.iinfo(np.int64).max


def _solve(k: int, width: int):
    """Cogrouped task: the chunk's k best rows for each of the block's queries."""

    def run(key, queries: pa.Table, data: pa.Table) -> pa.Table:
        q, x = matrix(queries.column("vec"), width), matrix(data.column("vec"), width)
        q_rows, rows = queries.column("query_row").to_numpy(), data.column("row_id").to_numpy()
        ids = data.column("vec_id").combine_chunks().fill_null(LAST_ID).to_numpy()
        out: tuple[list, list, list] = ([], [], [])
        for at in range(0, len(q), 256):
            scores = products(q[at : at + 256], x)
            for i, row in enumerate(q_rows[at : at + 256]):
                own = np.flatnonzero(rows != row)
                top = own[best(scores[i, own], ids[own], k)]
                out[0].append(np.full(len(top), row))
                out[1].append(ids[top])
                out[2].append(scores[i, top])
        cols = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
        vec_id = pa.array(cols[1], pa.int64(), mask=cols[1] == LAST_ID)
        return pa.table({"query_row": pa.array(cols[0]), "vec_id": vec_id, "score": pa.array(cols[2])})

    return run


def top_k(
    embeddings: DataFrame,
    k: int = 5,
    query_every: int = 50,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    n_pivots: int = 64,
    chunk_rows: int = 2048,
    block_queries: int = 2048,
) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by ``query_every``."""
    spark = embeddings.sparkSession
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    ints = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")))
    valid = embeddings.where(x.isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("vec"))
    rows = stored(with_row_id(valid), "vectors")

    width = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    chosen = rows.select("row_id", "vec").orderBy(F.xxhash64("vec"), "row_id").limit(n_pivots).collect()
    pivots = np.zeros((len(chosen), width), np.int64)
    for i, r in enumerate(chosen):
        pivots[i, : len(r["vec"])] = r["vec"]
    pivots = np.unique(pivots, axis=0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("vector_search")
        p = pivots.astype(np.float64)
        for batch in batches:
            v = matrix(batch.column("vec"), width).astype(np.float64)
            square = (p**2).sum(1)[None, :] - 2 * v @ p.T
            cell = square.argmin(1) if len(p) else np.zeros(len(v), np.int64)
            distance = np.sqrt(((v - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c) for c in ("row_id", "vec_id", "vec")}
                | {"cell": pa.array(cell, pa.int32()), "distance": distance, "norm": np.sqrt((v**2).sum(1))}
            )

    kind = "row_id long, vec_id long, vec array<long>, cell int, distance double, norm double"
    data = stored(rows.mapInArrow(assign, kind), "cells")
    summary = (
        data.groupBy("cell")
        .agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.max("norm").alias("norm"))
        .collect()
    )
    cells = {r["cell"]: (r["n"], r["radius"] * (1 + 1e-9) + 1e-6, r["norm"] * (1 + 1e-9) + 1e-6) for r in summary}
    queries = data.where(F.col("vec_id") % query_every == 0).select(
        F.col("row_id").alias("query_row"), F.col("vec").alias("vec"), F.col("cell").alias("cell")
    )

    result_kind = "query_row long, vec_id long, score long"

    def solve(sent: DataFrame) -> DataFrame:
        """Join queries sent to cells with the rows there, in chunks and blocks of bounded size."""
        load = {r["cell"]: r["n"] for r in sent.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        sizes = [
            (c, max(1, -(-n // chunk_rows)), max(1, -(-load[c] // block_queries))) for c, (n, _, _) in cells.items() if c in load
        ]
        if not sizes:
            return _ranked(spark.createDataFrame([], result_kind), k)
        plan = F.broadcast(spark.createDataFrame(sizes, "cell int, chunks int, blocks int"))  # at most n_pivots rows
        left = sent.join(plan, "cell").select(
            "cell",
            F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
            F.pmod(F.xxhash64("query_row"), F.col("blocks")).cast("int").alias("block"),
            "query_row",
            "vec",
        )
        right = data.join(plan, "cell").select(
            "cell",
            F.pmod(F.xxhash64("row_id"), F.col("chunks")).cast("int").alias("chunk"),
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            "row_id",
            "vec_id",
            "vec",
        )
        keys = ("cell", "chunk", "block")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_solve(k, width), result_kind)
        return _ranked(found, k)

    near = stored(solve(queries), "near")
    floors = near.where(F.col("rank") == k).select("query_row", F.col("score").alias("floor"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("vector_search")
        order = sorted(cells)
        p = pivots[order].astype(np.float64)
        radius, norm = np.array([cells[c][1] for c in order]), np.array([cells[c][2] for c in order])
        for batch in batches:
            v = matrix(batch.column("vec"), width).astype(np.float64)
            length = np.sqrt((v**2).sum(1))[:, None] * (1 + 1e-9)
            bound = np.minimum(v @ p.T + length * radius[None, :], length * norm[None, :]) + 1e-3
            floor = batch.column("floor").cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            reach = (bound * (1 + 1e-12) >= floor[:, None]) & (np.array(order)[None, :] != batch.column("cell").to_numpy()[:, None])
            q, c = np.nonzero(reach)
            taken = batch.take(pa.array(q))
            yield pa.RecordBatch.from_pydict(
                {"query_row": taken.column("query_row"), "vec": taken.column("vec"), "cell": pa.array(np.array(order, np.int32)[c], pa.int32())}
            )

    sent = queries.join(floors, "query_row", "left").select("query_row", "vec", "cell", "floor")
    far = solve(stored(sent.mapInArrow(spread, "query_row long, vec array<long>, cell int"), "sent"))
    merged = _ranked(near.drop("rank").unionByName(far.drop("rank")), k)
    names = data.where(F.col("vec_id") % query_every == 0).select(F.col("row_id").alias("query_row"), F.col("vec_id").alias("query_id"))
    return merged.join(names, "query_row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
