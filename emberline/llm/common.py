"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import threading
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.plans.lineage import cleaning

#: Rows of one Arrow batch at most. Texts are of any length, so the default of 10,000 rows could take gigabytes.
ARROW_ROWS = 512
#: Bytes of text that one call of a kernel gets, unless a single text is longer.
CHUNK_BYTES = 2_000_000


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches, and sees to it that checkpoint() has a folder: the cluster's, or one of our own where all runs on one machine."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, ARROW_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="emberline-"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder, so that a lost executor costs no recomputation. What was shuffled for it goes with it."""
    prepare(df.sparkSession)
    with cleaning(df.sparkSession):
        return df.select("*").checkpoint()


def fold(doc_id: Column, n: int) -> Column:
    """The remainder that divides documents into those to learn from and those held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def keyed(df: DataFrame) -> DataFrame:
    """Adds _k1 and _k2, which stand for a document in joins: its id (null: the least long) and a hash of its text.

    Rows that repeat id and text share a key. What is joined on the key has one row for each key, so repeated rows stay as many.
    """
    return df.withColumns({"_k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_k2": F.xxhash64(F.col("text"))})


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null: empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of at most that many bytes in a column, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def settle() -> None:
    """Gives memory that a task no longer uses back to the machine; the worker may stay for long."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def with_columns(df: DataFrame, kernel: Callable[[pa.RecordBatch], dict[str, pa.Array]], fields: list[T.StructField], sliced_by: str, most: int = CHUNK_BYTES) -> DataFrame:
    """The frame with columns that a kernel makes from each Arrow batch; columns of these names are replaced."""
    prepare(df.sparkSession)
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    keep = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, sliced_by, most):
            made = kernel(batch)
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keep] + [made[f.name] for f in fields]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(f.name for f in fields)])
        settle()

    return df.mapInArrow(run, T.StructType([*kept, *fields]))


def rows_from(df: DataFrame, kernel: Callable[[pa.RecordBatch], dict[str, pa.Array] | None], schema: T.StructType, sliced_by: str, most: int = CHUNK_BYTES) -> DataFrame:
    """Rows of another shape that a kernel makes from each Arrow batch."""
    prepare(df.sparkSession)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, sliced_by, most):
            made = kernel(batch)
            if made is not None:
                yield pa.RecordBatch.from_arrays([made[k] for k in names], names=names)
        settle()

    return df.mapInArrow(run, schema)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of many runs, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and how many each row has."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads unsigned 64-bit values over their range, one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """A filter of a fixed number of bits, set at each slot (long) of a frame."""
    packed = slots.selectExpr("cast(shiftright(slot, 6) as int) as w", "shiftleft(1L, cast(slot % 64 as int)) as b").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[packed["w"].to_numpy(dtype=np.int64)] = packed["b"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def hit(filter_: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether the slot in the first bits of each hash is set in a filter of bitmap()."""
    slot = hashes >> np.uint64(64 - bits)
    return (filter_[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


class Idle:
    """Calls a function once nothing has been in use for some seconds: Python workers outlive tasks, and what they remember takes memory from other stages."""

    def __init__(self, clear: Callable[[], object], seconds: float = 2.0) -> None:
        self.clear, self.seconds, self.timer = clear, seconds, None

    def __enter__(self) -> None:
        if self.timer:
            self.timer.cancel()

    def __exit__(self, *_: object) -> None:
        self.timer = threading.Timer(self.seconds, lambda: (self.clear(), settle()))
        self.timer.daemon = True
        self.timer.start()
