"""Exact top-k by inner product over a vector-approximation file.

The file has four bits of each component: its cell between the least and the largest value of that dimension in the whole table. It is written
once. For a query, a table says for each pair of dimensions what the 256 pairs of cells can add to the inner product at most; a scan of the
cells sums these limits. Exact vectors are read in the order of the sums, until the kth best exact score is above the limit of all that are left.

Vectors that are null, empty or hold null or non-finite components take no part; rows that repeat an id count once (see usable()); equal scores
go to the smaller id; vectors of different lengths are not compared. Extra columns are dropped. No queries or no candidates give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, prepare, table
from .vectors import Look, matrix, packed, search, together, usable, widths

#: Cells of a dimension: two of them make a byte.
CELLS = 16
#: Exact vectors read at once for a query.
STEP = 32
#: Queries whose limits are summed at once.
ROWS = 64
#: Sums of products are exact in doubles below this.
EXACT = 2.0**53
LONG = 2**63


def extent(base: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest value of each dimension of vectors of this width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(width, np.inf), np.full(width, -np.inf)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(low), pa.array(high)], names=["i", "low", "high"])

    got = base.select("v").mapInArrow(run, "i int, low double, high double").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").toPandas()
    return got["low"].to_numpy(), got["high"].to_numpy()


class Cells:
    """Limits of the cells of each dimension."""

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        self.low, self.step = low, np.maximum((high - low) / CELLS, 1e-300)
        self.largest = np.maximum(np.abs(low), np.abs(high))

    def code(self, vectors: np.ndarray) -> np.ndarray:
        """Two cells a byte; a last dimension without a partner goes with cell 0."""
        cell = np.clip(np.floor((vectors - self.low) / self.step), 0, CELLS - 1).astype(np.uint8)
        if cell.shape[1] % 2:
            cell = np.concatenate([cell, np.zeros((len(cell), 1), np.uint8)], axis=1)
        return cell[:, ::2] << 4 | cell[:, 1::2]

    def limits(self, queries: np.ndarray) -> np.ndarray:
        """What each pair of cells of each pair of dimensions adds to the inner product with each query at most."""
        edge = self.low + np.arange(CELLS + 1)[:, None] * self.step
        # a value may be put into a neighbouring cell by rounding, by next to nothing
        slack = 1e-9 * self.step + 1e-15 * self.largest
        low, high = (edge[:-1] - slack).T, (edge[1:] + slack).T
        most = np.maximum(queries[:, :, None] * low, queries[:, :, None] * high)
        if most.shape[1] % 2:
            most = np.concatenate([most, np.zeros((len(most), 1, CELLS))], axis=1)
        return (most[:, ::2, :, None] + most[:, 1::2, None, :]).reshape(len(queries), -1, CELLS * CELLS)

    def safe(self, queries: np.ndarray) -> bool:
        """Whether all scores of the queries are exact in doubles."""
        return float((np.abs(queries) @ self.largest).max(initial=0.0)) < EXACT


def products(vectors: np.ndarray, query: np.ndarray, safe: bool) -> np.ndarray:
    """Inner products of integer vectors as longs; those beyond a long are its limit."""
    if safe:
        return np.rint(vectors @ query).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in vectors.tolist()]
    return np.array([min(max(x, -LONG), LONG - 1) for x in exact], dtype=np.int64)


def scan(cells: Cells, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, vectors: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of queries, ids and scores of the k best of a block for each query."""
    out_q, out_v, out_s = [], [], []
    safe, n = cells.safe(queries), len(ids)
    columns = np.ascontiguousarray(code.T)
    for i0 in range(0, len(queries), ROWS):
        part = queries[i0 : i0 + ROWS]
        limits = cells.limits(part)
        bound = np.zeros((len(part), n))
        for j, column in enumerate(columns):
            bound += limits[:, j].take(column, axis=1)
        bound += 1e-12 * (np.abs(part) @ cells.largest)[:, None]
        ahead = min(n, STEP + k)
        first = np.argpartition(-bound, ahead - 1, axis=1)[:, :ahead] if ahead < n else np.broadcast_to(np.arange(n), bound.shape)
        for i, query in enumerate(part):
            at = first[i][ids[first[i]] != own[i0 + i]]
            score = products(vectors[at], query, safe)
            kth = np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -np.inf
            left = np.flatnonzero((bound[i] >= kth) & (ids != own[i0 + i]))
            left = left[~np.isin(left, at)]
            left = left[np.argsort(-bound[i, left], kind="stable")]
            for j in range(0, len(left), STEP):
                some = left[j : j + STEP]
                if bound[i, some[0]] < kth:
                    break
                at, score = np.concatenate([at, some]), np.concatenate([score, products(vectors[some], query, safe)])
                best = np.lexsort((ids[at], ~score))[:k]
                at, score = at[best], score[best]
                kth = score[-1] if len(score) >= k else -np.inf
            best = np.lexsort((ids[at], ~score))[:k]
            out_q.append(np.full(len(best), i0 + i))
            out_v.append(ids[at[best]])
            out_s.append(score[best])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def approximated(base: DataFrame, cells: Cells) -> DataFrame:
    """The file: vec_id, v and their cells as code, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = cells.code(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed(code), pa.array(np.zeros(batch.num_rows, np.int32))], names=["vec_id", "v", "code", "list"])

    return checkpointed(base.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, code binary, list int"))


def top_k(base: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score (long): the k largest inner products of integer vectors (vec_id, v) with each query."""
    prepare(base.sparkSession)
    found: list[DataFrame] = []
    for width, _ in widths(queries):
        mine = base.where(F.size("v") == width)
        low, high = extent(mine, width)
        if not len(low):
            continue
        cells = Cells(low, high)

        def searcher(own: np.ndarray, vectors: np.ndarray, cells: Cells = cells):
            def start() -> Look:
                return lambda ids, block, code, _: scan(cells, vectors, own, ids, block, code, k)

            return start

        found += search(approximated(mine, cells), queries.where(F.size("v") == width), width, k, searcher, "long")
    return together(base.sparkSession, found, "long")


def integers(df: DataFrame, vector: str = "embedding", factor: int = 256) -> DataFrame:
    """vec_id and v: components x as floor(factor * x), of vectors that take part; those beyond the range of doubles then do not."""
    whole = lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  others are whole numbers anyway
    rows = usable(df, vector).select("vec_id", F.transform("v", lambda x: whole(x * factor)).alias("v"))
    return rows.where(~F.exists("v", lambda x: F.abs(x) == float("inf")))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpointed(integers(table(spark, sf_dir, "embeddings")))
    return top_k(rows, rows.where("vec_id % 50 = 0"))
