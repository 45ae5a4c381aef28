"""Approximate nearest neighbours by cosine: inverted lists with an adaptive scan of dimensions.

Vectors are scaled to length 1 and rotated by a fixed random rotation. Lists belong to centres fitted on a bounded sample; their number grows with
the root of the table's size. Every row is put into the list of its nearest centre; the index, sorted by list, is written once. A query probes its
nearest lists, as many as hold CERTAIN of the sample's own neighbours and k rows of the sample at least. Within a list the rotated vectors are read in blocks of columns: after each
block, a test of the partial distance drops candidates that are too unlikely to be among the k nearest. What survives is scored in double
precision on the original vectors. First limits let the k nearest of the sample in probed lists pass every test, so a query is not left with fewer than k.

Null, empty, zero and non-finite vectors take no part; rows that repeat an id count once (see usable()); equal scores go to the smaller id; vectors
of different lengths are not compared. Extra columns are dropped. No queries or no candidates give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, prepare, table
from .vectors import Look, matrix, packed, search, together, usable, widths

#: Vectors at most, about, on which centres, probes and first limits are fitted.
SAMPLE = 8_192
#: Lists at least and at most, and the share of the sample's neighbours that probed lists must hold.
FEWEST, MOST, CERTAIN = 16, 1_024, 0.985
#: Columns read before each test, and how sure the test is: larger drops fewer.
COLUMNS, SURE = 16, 2.1
SEED = 20_240
#: Rows of a list that one task reads, about.
PART = 65_536
#: Queries held against a list at once.
ROWS = 512


def rotation(width: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1), 1e-300)[:, None]  # squares of large or small components stay in range
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def centres(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(SEED)
    c = x[rng.permutation(len(x))[: min(lists, len(x))]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        used = np.square(total).sum(axis=1) > 0
        c[used] = unit(total[used])
    return c


def probes_for(x: np.ndarray, c: np.ndarray, k: int, most: int = 512) -> int:
    """How many lists hold CERTAIN of the k nearest of the sample to its first vectors."""
    some = x[:most]
    near = some @ x.T
    near[np.arange(len(some)), np.arange(len(some))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(c)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    of = (x @ c.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(some @ c.T), axis=1, kind="stable"), axis=1)
    rank = np.sort(np.take_along_axis(place, of[best], axis=1).ravel())
    return int(rank[min(len(rank) - 1, int(np.ceil(CERTAIN * len(rank))) - 1)]) + 1


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, with sums over the same order of terms for every row."""
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def slack(hi: int, width: int) -> float:
    """What part of a limit the squared distance over the first columns may take."""
    return (1 + SURE / np.sqrt(hi)) ** 2 * (hi / width) if hi < width else 1.0


def passing(turned: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each query the least limit that lets its row of others (queries, vectors, columns) pass all tests of scan()."""
    width = turned.shape[1]
    partial = np.square(others - turned[:, None]).cumsum(axis=2)
    ends = [min(width, lo + COLUMNS) for lo in range(0, width, COLUMNS)]
    return np.max([partial[:, :, hi - 1].max(axis=1) / slack(hi, width) for hi in ends], axis=0) + 1e-6


def scan(x: np.ndarray, turned: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of queries and of candidates whose squared distance is within the query's limit, and the distances.

    Pairs are dropped between blocks of columns once a partial distance makes it too unlikely that the whole one is within the limit.
    """
    width = x.shape[1]
    q = v = d = None
    for lo in range(0, width, COLUMNS):
        hi = min(width, lo + COLUMNS)
        a, b = turned[:, lo:hi], x[:, lo:hi]
        most = limits * slack(hi, width)
        if q is None:
            d = np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)
            q, v = np.nonzero(d <= most[:, None] + 1e-6)
            d = d[q, v]
            continue
        gap = a[q] - b[v]
        d = d + (gap * gap).sum(axis=1)
        keep = d <= most[q] + 1e-6
        q, v, d = q[keep], v[keep], d[keep]
    return q, v, d


class Search:
    """A task's search of a block of queries; limits come down as candidates are found."""

    def __init__(self, own: np.ndarray, vectors: np.ndarray, turned: np.ndarray, probed: np.ndarray, limits: np.ndarray, k: int) -> None:
        self.own, self.vectors, self.turned, self.probed, self.limits, self.k = own, vectors, turned, probed, limits.copy(), k

    def look(self, ids: np.ndarray, vectors: np.ndarray, code: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = code.view(np.float32).astype(np.float64)
        order = np.argsort(lists, kind="stable")
        edges = np.flatnonzero(np.diff(lists[order], prepend=-1, append=-1))
        out_q, out_v, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for a, b in zip(edges, edges[1:], strict=False):
            at = order[a:b]
            who = np.flatnonzero(self.probed[:, lists[at[0]]])
            for i in range(0, len(who), ROWS):
                some = who[i : i + ROWS]
                q, v, d = scan(x[at], self.turned[some], self.limits[some])
                q, v = some[q], at[v]
                other = ids[v] != self.own[q]
                q, v, d = self.closest(q[other], v[other], d[other])
                out_q.append(q)
                out_v.append(ids[v])
                out_s.append(cosines(self.vectors[q], vectors[v]))
        return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)

    def closest(self, q: np.ndarray, v: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query the candidates no farther than its kth, which limits what comes later."""
        order = np.lexsort((d, q))
        q, v, d = q[order], v[order], d[order]
        start = np.flatnonzero(np.diff(q, prepend=-1))
        many = np.diff(start, append=len(q))
        full = many >= self.k
        kth = np.full(len(start), np.inf)
        kth[full] = d[start[full] + self.k - 1]
        self.limits[q[start]] = np.minimum(self.limits[q[start]], kth + 1e-6)
        keep = d <= np.repeat(kth, many) + 1e-6
        return q[keep], v[keep], d[keep]


def indexed(base: DataFrame, c: np.ndarray, turn: np.ndarray) -> DataFrame:
    """The index: vec_id, v, the rotated vector (code, 32-bit) and the list of each row, sorted by list and written once.

    A list of very many rows, such as copies of one vector, is dealt over several partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column(1)))
                near = (x @ c.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed((x @ turn).astype(np.float32)), pa.array(near)], names=["vec_id", "v", "code", "list"])

    rows = checkpointed(base.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, code binary, list int"))
    parts = rows.groupBy("list").agg(F.ceil(F.count("*") / PART).alias("parts"))  # a row for each list, MOST at most
    n = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    return checkpointed(dealt.repartition(n, "list", "part").sortWithinPartitions("list", "vec_id").select("vec_id", "v", "code", "list"))


def nearest(base: DataFrame, queries: DataFrame, k: int = 5, lists: int | None = None, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score (cosine): about the k nearest of (vec_id, v) to each query. lists and probes: fitted if not given."""
    prepare(base.sparkSession)
    found: list[DataFrame] = []
    counts = dict(widths(base))
    for width, _ in widths(queries):
        if width not in counts:
            continue
        mine, n = base.where(F.size("v") == width), counts[width]
        share = min(1.0, SAMPLE / n)
        drawn = mine.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).toPandas()
        if not len(drawn):  # a few rows of many, by an odd chance
            drawn = mine.limit(SAMPLE).toPandas()
        sample, known = unit(np.stack(drawn["v"].to_list()).astype(np.float64)), drawn["vec_id"].to_numpy()
        c = centres(sample, lists or int(min(MOST, max(FEWEST, n**0.5))))
        turn, many = rotation(width), probes or probes_for(sample, c, k)
        turned_sample, of = sample @ turn, (sample @ c.T).argmax(axis=1)

        def searcher(own: np.ndarray, vectors: np.ndarray, c: np.ndarray = c, turn: np.ndarray = turn, many: int = many, sample: np.ndarray = sample, known: np.ndarray = known, turned_sample: np.ndarray = turned_sample, of: np.ndarray = of):
            x = unit(vectors)
            probed = np.zeros((len(x), len(c)), dtype=bool)
            limits, turned = np.full(len(x), np.inf), x @ turn
            for i in range(0, len(x), ROWS):
                other = known != own[i : i + ROWS, None]
                order = np.argsort(np.argsort(-(x[i : i + ROWS] @ c.T), axis=1, kind="stable"), axis=1)
                place = np.where(other, order[:, of], len(c))
                if len(known) <= k:
                    probed[i : i + ROWS] = True
                    continue
                depth = np.maximum(many - 1, np.minimum(np.partition(place, k - 1, axis=1)[:, k - 1], len(c) - 1))[:, None]
                probed[i : i + ROWS] = order <= depth
                # rows of the sample in these lists are candidates, so the kth of them limits the kth of all
                near = np.where(other & (place <= depth), x[i : i + ROWS] @ sample.T, -np.inf)
                limits[i : i + ROWS] = passing(turned[i : i + ROWS], turned_sample[np.argpartition(-near, k - 1, axis=1)[:, :k]])

            def start() -> Look:
                return Search(own, vectors, turned, probed, limits, k).look

            return start

        found += search(indexed(mine, c, turn), queries.where(F.size("v") == width), width, k, searcher, "double")
    return together(base.sparkSession, found, "double")


def nonzero(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return usable(df, vector).where(F.exists("v", lambda x: x != 0))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpointed(nonzero(table(spark, sf_dir, "embeddings")))
    return nearest(rows, rows.where("vec_id % 50 = 0"))
