"""Line deduplication by fingerprints of runs of lines.

A run of lines that occurs earlier is deleted if it is long: BYTES of UTF-8 or more, or LINES lines or more. So one long line counts, and a chance
repeat of one or two short ones does not. Earlier is meant in the order of document id, hash of the text and line. Lines that are blank do not
count; lines are equal if they are without white space at their ends.

Every line gives the shortest long run that begins with it and the shortest that ends with it; their hashes are the fingerprints, and the window of
winnowing is one, as all of them are kept. Any line of a long run that repeats lies in such a shortest run that lies within, and what is the
shortest is told from the run's own lines alone. So a line goes exactly if one of these around it has an earlier occurrence, whichever document
that is in, and no match is extended.

What is handed on is the first occurrence of each fingerprint, found by partial aggregation, and never a join on a fingerprint: a line that a
third of all documents have is no hot key. Null and empty texts have no lines. Rows that repeat id and text are one document and stay as many.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed, mix, prepare, ragged, rows_from, table, with_columns
from .substrings import content

#: A repeated run goes from so many bytes (of its lines, without white space at their ends) or from so many lines.
BYTES, LINES = 40, 3


def split(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Lines of texts that are not blank, flat, with their sizes, and how many each text has."""
    found = [[y.encode("utf-8", "surrogatepass") for x in t.split("\n") if (y := x.strip())] for t in texts]
    flat = [y for x in found for y in x]
    return flat, np.array([len(x) for x in flat], dtype=np.int64), np.array([len(x) for x in found], dtype=np.int64)


def shortest(sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of the shortest long runs that begin or end with a line, each once; runs stay within a text."""
    n = len(sizes)
    line, total = np.arange(n), np.concatenate([[0], np.cumsum(sizes)])
    before = ragged(np.zeros(len(counts), dtype=np.int64), counts)
    left = np.repeat(counts, counts) - before
    ahead, back = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for k in range(LINES, 0, -1):
        a, b = line[left >= k], line[before + 1 >= k]
        ahead[a[(total[a + k] - total[a] >= BYTES) | (k == LINES)]] = k
        back[b[(total[b + 1] - total[b + 1 - k] >= BYTES) | (k == LINES)]] = k
    begins = line - back + 1
    other = (back > 0) & (ahead[np.minimum(begins, n - 1)] != back)
    return np.concatenate([line[ahead > 0], begins[other]]), np.concatenate([ahead[ahead > 0], back[other]])


def places(counts: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text that each run is in, and a number that tells it from the text's other runs and rises with its first line."""
    text = np.repeat(np.arange(len(counts)), counts)[starts]
    return text, (starts - (np.cumsum(counts) - counts)[text]) * LINES + lengths - 1


def firsts(docs: DataFrame) -> DataFrame:
    """_k1, _k2 and _first (array of the places of runs that no earlier run is equal to) of documents of a keyed frame."""
    prepare(docs.sparkSession)

    def kernel(batch: pa.RecordBatch) -> dict[str, pa.Array] | None:
        flat, sizes, counts = split([x or "" for x in batch.column(0).to_pylist()])
        starts, lengths = shortest(sizes, counts)
        if not len(starts):
            return None
        h = content(np.frombuffer(b"".join(flat), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes)
        print_ = np.zeros(len(starts), dtype=np.uint64)
        for k in range(LINES):
            more = lengths > k
            print_[more] = mix(print_[more] + h[starts[more] + k])
        text, at = places(counts, starts, lengths)
        return {"_k1": batch.column(1).take(pa.array(text)), "_k2": batch.column(2).take(pa.array(text)), "at": pa.array(at.astype(np.int32)), "print": pa.array(print_.view(np.int64))}

    prints = rows_from(docs.select("text", "_k1", "_k2"), kernel, T._parse_datatype_string("_k1 long, _k2 long, at int, print long"), "text")
    first = prints.groupBy("print").agg(F.min(F.struct("_k1", "_k2", "at")).alias("f")).select("f.*")
    return first.groupBy("_k1", "_k2").agg(F.collect_list("at").alias("_first"))


def remove(df: DataFrame) -> DataFrame:
    """Adds kept (string: the text without its later repeated runs, null as it was), n_lines, n_removed and n_runs; such columns are replaced."""
    docs = keyed(df.drop("kept", "n_lines", "n_removed", "n_runs"))
    joined = docs.join(firsts(docs), ["_k1", "_k2"], "left").drop("_k1", "_k2")

    def kernel(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        known = batch.column(batch.schema.get_field_index("_first")).to_pylist()
        _, sizes, counts = split([x or "" for x in texts])
        starts, lengths = shortest(sizes, counts)
        text, at = places(counts, starts, lengths)
        own = np.array([i << 32 | x for i, found in enumerate(known) for x in found or ()], dtype=np.int64)
        later = ~np.isin(text << 32 | at, own)
        change = np.zeros(len(sizes) + 1, dtype=np.int64)
        np.add.at(change, starts[later], 1)
        np.add.at(change, (starts + lengths)[later], -1)
        kept, removed, n_runs = [], [], []
        for t, order in zip(texts, np.split(np.cumsum(change)[:-1] > 0, np.cumsum(counts)[:-1]), strict=True):
            removed.append(int(order.sum()))
            n_runs.append(int((np.diff(order.astype(np.int8), prepend=0) > 0).sum()))
            if removed[-1]:
                flags = iter(order.tolist())
                t = "\n".join(x for x in t.split("\n") if not (x.strip() and next(flags)))
            kept.append(t)
        return {"kept": pa.array(kept, pa.string()), "n_lines": pa.array(counts), "n_removed": pa.array(removed, pa.int64()), "n_runs": pa.array(n_runs, pa.int64())}

    fields = [T.StructField("kept", T.StringType()), *(T.StructField(k, T.LongType()) for k in ("n_lines", "n_removed", "n_runs"))]
    return with_columns(joined, kernel, fields, "text").drop("_first")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
