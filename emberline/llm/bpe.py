"""Byte-level BPE encoding and decoding over padded numpy matrices.

A text is cut by the tokenizer's pattern; every distinct piece becomes a row of a matrix with rows of similar length. In each round every
row merges its leftmost pair of the least rank, found in a hash table of pairs, and becomes one column shorter; rows that have nothing to
merge leave the matrix. A null text counts as empty and has no ids; a null list of ids decodes to no bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lists, mix, prepare, ragged, table, with_columns

VOCABULARY = "byte_bpe_50k.tiktoken"
#: No rank is as large.
NONE = np.int32(2**31 - 1)
#: Widest piece, in bytes, that is merged in a matrix; a longer one is merged alone.
WIDEST = 128
#: Distinct pieces that a worker remembers before it starts anew.
REMEMBERED = 400_000
#: Pieces found at once in a very long text.
PIECES = 500_000


class PairTable:
    """Open-addressing hash table from two adjacent ids to the id they merge into."""

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        self.bits = max(4, int(len(pairs) * 2.5).bit_length())
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        values = np.array(list(pairs.values()), dtype=np.int32)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]
            self.values[slot[free]] = values[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        won = self.find(keys // 2**32, keys % 2**32)
        assert np.array_equal(won, values)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where two ids do not merge."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class ByteBpe:
    """Encodes texts to ids and decodes ids to bytes; holds a vocabulary and the pieces met of late."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.of_byte = of_byte
        self.pairs = PairTable({(self.ranks[t[:i]], self.ranks[t[i:]]): r for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks})
        words = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            words[r] = t
        self.lengths = np.array([len(x) for x in words], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(words), dtype=np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.int32)
        self.first = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)

    def merge_rows(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of a matrix, where ids beyond a row's length are -1: the same ids flat, and their number for each row."""
        n, width = ids.shape
        done, counts, rows = np.full((n, width), -1, dtype=np.int32), lengths.copy(), np.arange(n)
        rank = np.full((n, max(width - 1, 0)), NONE, dtype=np.int32)
        live = ids[:, 1:] >= 0
        rank[live] = self.pairs.find(ids[:, :-1][live], ids[:, 1:][live])
        while len(rows):
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), dtype=np.int64)
            value = rank[np.arange(len(rows)), best] if rank.shape[1] else np.full(len(rows), NONE)
            over = value == NONE
            if over.any():
                done[rows[over], : ids.shape[1]] = ids[over]
                ids, rank, best, value, rows = ids[~over], rank[~over], best[~over], value[~over], rows[~over]
                if not len(rows):
                    break
            at = np.arange(len(rows))
            ids[at, best] = value
            counts[rows] -= 1
            columns = np.arange(ids.shape[1] - 1)[None]
            ids = np.take_along_axis(ids, columns + (columns > best[:, None]), axis=1)
            columns = columns[:, :-1]
            rank = np.take_along_axis(rank, columns + (columns >= best[:, None]), axis=1)
            for shift in (-1, 0):  # the pairs before and after the merged id
                k = best + shift
                ok = np.flatnonzero((k >= 0) & (k < ids.shape[1] - 1))
                ok = ok[ids[ok, k[ok] + 1] >= 0]
                rank[ok, k[ok]] = self.pairs.find(ids[ok, k[ok]], ids[ok, k[ok] + 1])
        return done[done >= 0], counts

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """As merge_rows for a single long row; takes all places of the least pair at once where that comes to the same."""
        while len(ids) > 1:
            rank = self.pairs.find(ids[:-1], ids[1:])
            least = rank.min()
            if least == NONE:
                break
            at = np.flatnonzero(rank == least)
            run = np.concatenate([[True], np.diff(at) > 1])
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]  # of places that overlap, every other one
            trial = self._merged(ids, at, least)
            around = self.pairs.find(trial[:-1], trial[1:])
            touched = np.flatnonzero((trial[:-1] == least) | (trial[1:] == least))
            if len(at) > 1 and (around[touched] < least).any():
                trial = self._merged(ids, at[:1], least)
            ids = trial
        return ids

    @staticmethod
    def _merged(ids: np.ndarray, at: np.ndarray, value: int) -> np.ndarray:
        out, keep = ids.copy(), np.ones(len(ids), dtype=bool)
        out[at] = value
        keep[at + 1] = False
        return out[keep]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, flat in their order, and their number for each piece."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        counts = np.zeros(len(pieces), dtype=np.int64)
        length = np.array([len(x) for x in pieces], dtype=np.int64)
        whole = np.array([self.ranks.get(x, -1) for x in pieces], dtype=np.int32)
        for i in np.flatnonzero(whole >= 0):
            out[i], counts[i] = whole[i : i + 1], 1
        rest = np.flatnonzero((whole < 0) & (length <= WIDEST))
        bucket = np.where(length <= 16, (length + 3) // 4 * 4, 1 << np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64))
        for width in np.unique(bucket[rest]):
            rows = rest[bucket[rest] == width]
            matrix = np.full((len(rows), width), -1, dtype=np.int32)
            flat = self.of_byte[np.frombuffer(b"".join(pieces[i] for i in rows), dtype=np.uint8)]
            matrix[np.repeat(np.arange(len(rows)), length[rows]), ragged(np.zeros(len(rows), dtype=np.int64), length[rows])] = flat
            ids, n = self.merge_rows(matrix, length[rows])
            counts[rows] = n
            for i, part in zip(rows, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                out[i] = part
        for i in np.flatnonzero((whole < 0) & (length > WIDEST)):
            out[i] = self.merge_long(self.of_byte[np.frombuffer(pieces[i], dtype=np.uint8)])
            counts[i] = len(out[i])
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int32), counts

    def _remember(self, pieces: list[str]) -> None:
        ids, counts = self.encode_pieces([x.encode() for x in pieces])
        base = len(self.index)
        self.index.update(zip(pieces, range(base, base + len(pieces)), strict=True))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.ids = np.concatenate([self.ids, ids])

    def _encode_found(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and their number for each piece."""
        at = list(map(self.index.get, found))
        if None in at:
            if len(self.index) > REMEMBERED:
                self._forget()
            self._remember(list({x for x in found if x not in self.index}))
            at = list(map(self.index.__getitem__, found))
        place = np.array(at, dtype=np.int64)
        sizes = self.count[place]
        return self.ids[ragged(self.first[place], sizes)], sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, flat in their order, and their number for each text."""
        out, counts = [], np.zeros(len(texts), dtype=np.int64)
        held: list[str] = []
        ends: list[tuple[int, int]] = []

        def flush() -> None:
            if held:
                ids, sizes = self._encode_found(held)
                total, last = np.concatenate([[0], np.cumsum(sizes)]), 0
                for i, end in ends:
                    counts[i] += total[end] - total[last]
                    last = end
                out.append(ids)
            held.clear()
            ends.clear()

        for i, text in enumerate(texts):
            if len(text) <= PIECES:
                held += self.pattern.findall(text)
                ends.append((i, len(held)))
            else:
                for m in self.pattern.finditer(text):
                    held.append(m[0])
                    if len(held) >= PIECES:
                        ends.append((i, len(held)))
                        flush()
                ends.append((i, len(held)))
            if len(held) >= PIECES:
                flush()
        flush()
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int32), counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of lists of ids, flat in their order, and their number for each list."""
        sizes = self.lengths[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts)
        return self.blob[ragged(self.starts[ids], sizes)], total[ends] - total[ends - counts]


@lru_cache(maxsize=4)
def model(path: str, pattern: str) -> ByteBpe:
    """One model for each worker process."""
    return ByteBpe(path, pattern)


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds the ids of a text column. path is the rank file, as every worker finds it. A column of the new name is replaced."""
    path = path or public_tokenizers.path(VOCABULARY)

    def kernel(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = ["" if x is None else x for x in batch.column(text).to_pylist()]
        ids, counts = model(path, pattern).encode(texts)
        return {out: lists(ids, counts, pa.int32())}

    return with_columns(df, kernel, [T.StructField(out, T.ArrayType(T.IntegerType()))], text)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds the bytes of a column of ids. A column of the new name is replaced."""
    path = path or public_tokenizers.path(VOCABULARY)

    def kernel(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column = batch.column(ids)
        counts = np.asarray(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
        data, sizes = model(path, pattern).decode(flat, counts)
        offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
        np.cumsum(sizes, out=offsets[1:])
        return {out: pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])}

    prepare(df.sparkSession)
    field = T.StructField(out, T.BinaryType())
    kept = [f for f in df.schema.fields if f.name != out]
    keep = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                made = kernel(part)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(k)) for k in keep] + [made[out]], names=[*keep, out])

    return df.mapInArrow(run, T.StructType([*kept, field]))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode(docs).select("doc_id", "ids")
    return decode(ids).select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2(F.translate(F.col("ids").cast("string"), "[],", "").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
