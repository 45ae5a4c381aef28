"""What both vector searches share: rows that take part, queries in blocks, and merging of what tasks have found.

A search reads a file of candidates that has been written once, with a code of each vector beside it. A block of queries is of at most a fixed
number of bytes and goes to all tasks; each task reads its part of the file and gives the k best of what it has read for each query. So no
vector or key can be hot, and the rounds grow with the queries alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, prepare

#: Bytes of the queries of one round at most, about: a bound on what goes to the tasks at once.
QUERY_BYTES = 1 << 23
#: Candidates that a task searches at once, and bytes of their vectors at most.
BLOCK, BLOCK_BYTES = 8_192, 1 << 25

#: ids, vectors, codes and lists of a block of candidates -> positions of queries, ids and scores of what was found.
Look = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and v (array<double>): vectors with an id and without null or non-finite components, each id once.

    Of rows that repeat an id the one whose vector comes first in the order of arrays counts. Other columns are dropped.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def codes(column: pa.Array) -> np.ndarray:
    """Rows of bytes of a binary column whose values are of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def packed(rows: np.ndarray) -> pa.Array:
    """A binary column of the bytes of each row of a matrix."""
    return pa.array([x.tobytes() for x in rows], pa.binary())


def widths(rows: DataFrame) -> list[tuple[int, int]]:
    """Lengths of vectors and how many there are of each."""
    return [(r["d"], r["count"]) for r in rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]


def rounds(queries: DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries of one length, block after block."""
    n = queries.count()
    blocks = -(-n // most)
    for b in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toPandas().sort_values("vec_id", kind="stable")
        if len(got):
            yield got["vec_id"].to_numpy(), np.stack(got["v"].to_list()).astype(np.float64)


def search(file: DataFrame, queries: DataFrame, width: int, k: int, searcher: Callable[[np.ndarray, np.ndarray], Callable[[], Look]], score_type: str) -> list[DataFrame]:
    """query_id, rank, vec_id, score of each round: for each query its k highest, ties to the smaller id.

    file: vec_id, v, code (binary) and list of vectors of this width. searcher(ids, vectors) gets a block of queries; what it returns is
    called in each task and gives a function of a block of candidates.
    """
    prepare(file.sparkSession)
    kind, own = (pa.int64(), np.int64) if score_type == "long" else (pa.float64(), np.float64)
    most = max(1, min(BLOCK, BLOCK_BYTES // (8 * width)))
    found: list[DataFrame] = []
    for ids, vectors in rounds(queries, max(1, QUERY_BYTES // (8 * width))):
        start = searcher(ids, vectors)

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, start: Callable[[], Look] = start) -> Iterator[pa.RecordBatch]:
            look = start()
            q, v, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, own)
            held: list[pa.RecordBatch] = []

            def merged() -> None:
                nonlocal q, v, s
                block = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                a, b, c, d = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in block.columns)
                got = look(a.to_numpy(), matrix(b), codes(c), d.to_numpy())
                q, v, s = np.concatenate([q, got[0]]), np.concatenate([v, got[1]]), np.concatenate([s, got[2]])
                order = np.lexsort((v, ~s if score_type == "long" else -s, q))
                q, v, s = q[order], v[order], s[order]
                starts = np.flatnonzero(np.diff(q, prepend=-1))
                keep = np.arange(len(q)) - np.repeat(starts, np.diff(starts, append=len(q))) < k
                q, v, s = q[keep], v[keep], s[keep]

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                if sum(x.num_rows for x in held) >= most:
                    merged()
            if held:
                merged()
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(v), pa.array(s, kind)], names=["query_id", "vec_id", "score"])

        part = file.select("vec_id", "v", "code", "list").mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
        part = part.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        found.append(part.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    return found


def together(spark, found: list[DataFrame], score_type: str) -> DataFrame:
    if not found:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {score_type}")
    if len(found) > 8:  # many rounds: each is written before the next one, so that plans stay small
        found = [checkpointed(x) for x in found]
    return reduce(DataFrame.unionByName, found)
