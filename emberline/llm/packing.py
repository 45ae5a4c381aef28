"""Packing of tokenised documents into windows of near-equal size by Karmarkar-Karp multiway differencing.

A document's tokens are the tokenizer's ids and an end id. Whole windows are cut off a document first and each fills a sequence. What is
left is cut into pieces of bounded length, and pieces are gathered until their total comes just under a whole number of windows. Differencing
then deals them out: every piece starts as a partial partition; the two partial partitions of the largest imbalance are merged, the full
parts of one with the empty parts of the other, until one partition is left. If its fullest window is beyond capacity, one more window is
tried. A block of pieces is of bounded size and stays within the task that read it, so nothing is shuffled; sequence ids hold the number of
the task in their upper bits and are the same when a lost task runs again. A null or empty text is a document of the end id alone.
"""

from __future__ import annotations

import heapq
import os
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Idle, prepare, ragged, slices, table

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 1
#: Tokens of a piece at most, once whole windows are cut off.
PIECE = 512
#: Windows that a block of pieces fills, and tokens that it leaves free in each, by which differencing can balance them.
WINDOWS, SLACK = 256, 4
#: Distinct words that a worker remembers before it starts anew: about 400 MB.
REMEMBERED = 1_000_000


class Numbers(dict):
    """Numbers strings in the order in which they are first asked for; new holds those not numbered before."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class Runs:
    """Runs of ids by number; grows without copying everything each time."""

    def __init__(self) -> None:
        self.ids, self.first, self.count = np.zeros(1024, dtype=np.uint32), np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.used = self.rows = 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.rows + len(counts) > len(self.count):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[self.rows : self.rows + len(counts)] = self.used + np.cumsum(counts) - counts
        self.count[self.rows : self.rows + len(counts)] = counts
        self.used += len(ids)
        self.rows += len(counts)

    def take(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs, flat, and how many each has."""
        sizes = self.count[place]
        return self.ids[ragged(self.first[place], sizes)], sizes


class WordTokens:
    """Ids of texts by the tokenizer; what is between white space is tokenised once and remembered.

    Its pieces are found by the tokenizer's own pattern, and those not met before go to the tokenizer, many in one text with spaces between
    them: the last id of each is one of a word's end, which tells them apart. Texts with characters beyond the Latin blocks go to the
    tokenizer as a whole, since they may need its Unicode normal form. Strings that name special tokens are ordinary text.
    """

    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    OTHER = regex.compile(r"[^\x00-\x1b\x20-ɏ]")  # nor the separators that only Python splits at

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.remembered = remembered
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.words, self.word_ids = Numbers(), Runs()
        self.pieces, self.piece_ids = Numbers(), Runs()

    def _remember(self) -> None:
        parts = [self.PATTERN.findall(x) for x in self.words.new]
        self.words.new.clear()
        at = np.array(list(map(self.pieces.__getitem__, (x for p in parts for x in p))), dtype=np.int64)
        new = self.pieces.new
        for i in range(0, len(new), 500):
            ids = np.array(self.tokenizer.encode(" ".join(new[i : i + 500]), add_special_tokens=False).ids, dtype=np.uint32)
            counts = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            assert len(counts) == len(new[i : i + 500]), "a piece is not one word"
            self.piece_ids.add(ids, counts)
        new.clear()
        ids, counts = self.piece_ids.take(at)
        total, ends = np.concatenate([[0], np.cumsum(counts)]), np.cumsum([len(p) for p in parts])
        self.word_ids.add(ids, np.diff(total[np.concatenate([[0], ends])]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        words: list[str] = []
        ends: list[tuple[int, int]] = []
        if len(self.words) > self.remembered:
            self._forget()
        for i, text in enumerate(texts):
            if self.OTHER.search(text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            else:
                words += text.lower().split()
                ends.append((i, len(words)))
        place = np.array(list(map(self.words.__getitem__, words)), dtype=np.int64)
        if self.words.new:
            self._remember()
        flat, sizes = self.word_ids.take(place)
        total, last = np.concatenate([[0], np.cumsum(sizes)]), 0
        for i, end in ends:
            out[i] = flat[total[last] : total[end]]
            last = end
        return out


@lru_cache(maxsize=4)
def tokenizer(path: str, remembered: int = REMEMBERED) -> WordTokens:
    """One for each worker process."""
    return WordTokens(path, remembered)


IDLE = Idle(tokenizer.cache_clear)


def differencing(sizes: list[int], parts: int) -> list[tuple[int, list[int]]]:
    """Deals sizes out to that many parts with near-equal sums: each part's sum and the positions of its sizes."""
    if not sizes:
        return []
    # a partial partition: ascending (sum, number of the bin, bin); bins are trees of positions; parts not listed are empty
    serial = len(sizes)
    heap = [(-n, i, [(n, i, i)]) for i, n in enumerate(sizes)]
    if parts == 1:
        return [(sum(sizes), list(range(len(sizes))))]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        if len(b) == 1:
            if len(a) < parts:
                insort(a, b[0])
            else:
                low, (n, _, x) = a.pop(0), b[0]
                serial += 1
                insort(a, (low[0] + n, serial, (low[2], x)))
        else:
            full, empty = b[::-1], parts - len(a)  # the fullest of b meet the emptiest of a
            merged = full[:empty]
            rest = full[empty:]
            for low, high in zip(a, rest, strict=False):
                serial += 1
                merged.append((low[0] + high[0], serial, (low[2], high[2])))
            merged += a[len(rest) :]
            a = sorted(merged)
        gap = a[-1][0] - (a[0][0] if len(a) == parts else 0)
        serial += 1
        heapq.heappush(heap, (-gap, serial, a))
    out = []
    for total, _, tree in heap[0][2]:
        members, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                members.append(x)
        out.append((total, members))
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of sizes for each window; the window count rises until no window is beyond capacity."""
    parts = max(1, -(-sum(sizes) // capacity)) if sizes else 0
    while sizes:
        dealt = differencing(sizes, parts)
        if max(n for n, _ in dealt) <= capacity:
            return [x for _, x in dealt]
        parts += 1
    return []


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("tokens", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


class Packer:
    """Gathers the pieces of one task and gives out rows of PIECES."""

    def __init__(self, task: int, capacity: int, piece: int) -> None:
        self.capacity, self.piece = capacity, piece
        self.next = task << 33
        self.target = WINDOWS * max(1, capacity - SLACK)
        self.held: list[tuple] = []
        self.total = 0
        self.rows: list[tuple] = []

    def _put(self, members: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, n in members:
            self.rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), n, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.capacity:
            self._put([(doc, at, ids[at : at + self.capacity], n)])
            at += self.capacity
        left = n - at
        if left:
            cuts = -(-left // self.piece)
            step = -(-left // cuts)
            while at < n:
                m = min(step, n - at, self.target - self.total)
                self.held.append((doc, at, ids[at : at + m], n))
                self.total += m
                at += m
                if self.total >= self.target:
                    self.flush()

    def flush(self) -> None:
        for members in windows([len(x[2]) for x in self.held], self.capacity):
            self._put([self.held[i] for i in members])
        self.held, self.total = [], 0

    def take(self) -> pa.RecordBatch | None:
        rows, self.rows = self.rows, []
        if not rows:
            return None
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=PIECES.names)


def pack(df: DataFrame, capacity: int = CAPACITY, piece: int = PIECE, path: str | None = None, end_id: int = END_ID, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of documents and where they lie in sequences; tokens are unsigned 32-bit little-endian ids.

    Takes doc_id and text; other columns are left out, and repeated rows are packed each. Cutting at capacity and piece length bounds
    what one row holds. remembered: distinct words that a worker keeps; fewer take less memory and more time.
    """
    prepare(df.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from emberline.llm.packing import IDLE  # the worker's own, not a copy that travels with the task

        with IDLE:
            yield from packed(batches)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), capacity, piece)
        end = np.array([end_id], dtype=np.uint32)
        for batch in slices(batches, "text"):
            texts = ["" if x is None else x for x in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), tokenizer(path, remembered).encode(texts), strict=True):
                packer.add(doc, np.concatenate([ids, end]))
            if (made := packer.take()) is not None:
                yield made
        packer.flush()
        if (made := packer.take()) is not None:
            yield made

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
