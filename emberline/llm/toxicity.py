"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: density and strength of words of a lexicon, lexicon words near second-person words, capitals, punctuation and obfuscation
rates. The lexicon holds a short fixed list and word stems whose share of toxic documents is high among the labelled; stems are hashed to
a fixed number of buckets, so the lexicon is of bounded size. For training, a document's lexicon comes from the other folds. A null or
empty text has no words and gets the score of its features like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import labelled
from .common import fold, prepare, slices, table, with_columns
from .words import WordTable, byte_counts, isotonic, maxima, sums

#: Insults of general use, a fixed list.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown fool imbecile jerk dummkopf trottel abschaum connard abruti imbécile crétin estúpido imbécil basura".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie ihnen tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})
STRIP = ".,;:!?\"'()[]{}<>«»„“”…-–—*_~|/\\#%&$+="
BUCKET_BITS, FOLDS, NEAR = 20, 4, 4
FEATURES = ("strength", "hits", "most", "log_hits", "fixed", "near_you", "you", "capitals", "exclaims", "punctuation", "obfuscated", "shouted", "log_words")


def stems(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n)]


def bucket(stem: str) -> int:
    return zlib.crc32(stem.encode("utf-8", "surrogatepass")) >> (32 - BUCKET_BITS)


def plain(word: str) -> tuple[str, bool]:
    """A word in lower case without marks around it, and whether marks or digits are mixed into it."""
    core = word.strip(STRIP).lower()
    if core.isalpha() or not core:
        return core, False
    mixed = any(c.isalpha() for c in core) and any(not c.isalpha() and c not in "'-’.,/" for c in core)
    return (core.translate(LEET) if mixed else core), mixed


class Featurizer:
    """Features of texts by a lexicon: bucket to weight."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray) -> None:
        self.lexicon = dict(zip(buckets.tolist(), weights.tolist(), strict=True))
        self.table = WordTable(self._describe)

    def _describe(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), 5), dtype=np.float32)
        get = self.lexicon.get
        for i, word in enumerate(words):
            core, mixed = plain(word)
            if core:
                fixed = core in INSULTS
                out[i] = max(2.0 * fixed, *(get(bucket(s), 0.0) for s in stems(core))), fixed, core in SECOND_PERSON, mixed, len(core) > 2 and word.isupper()
        return out

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        parts = [x.decode("utf-8", "replace").split() for x in texts]
        counts = np.array([len(x) for x in parts], dtype=np.int64)
        known = self.table.look_up([w for x in parts for w in x])
        weight, fixed, you, mixed, loud = known.T
        hit = weight > 0
        place = np.repeat(np.arange(len(texts)), counts)
        near = np.zeros(len(weight), dtype=bool)
        for d in range(1, NEAR + 1):
            same = place[d:] == place[:-d]
            near[d:] |= (you[:-d] > 0) & same
            near[:-d] |= (you[d:] > 0) & same
        total = sums(np.stack([weight, hit, fixed, hit & near, you, mixed, loud], axis=1), counts)
        n = np.maximum(counts, 1)[:, None]
        bytes_ = byte_counts(texts)
        size = np.maximum(bytes_.sum(axis=1), 1)
        upper = bytes_[:, 65:91].sum(axis=1)
        letters = np.maximum(upper + bytes_[:, 97:123].sum(axis=1) + bytes_[:, 195:240].sum(axis=1), 1)
        marks = bytes_[:, 33:48].sum(axis=1) + bytes_[:, 58:65].sum(axis=1)
        share = total / n
        return np.column_stack([share[:, 0], share[:, 1], maxima(weight, counts), np.log1p(total[:, 1]), share[:, 2], share[:, 3], share[:, 4], upper / letters, bytes_[:, 33] / size, marks / size, share[:, 5], share[:, 6], np.log1p(counts)])


class Boosted:
    """Gradient-boosted trees of fixed depth for the logistic loss, on binned features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, width = x.shape
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for c in x.T]
        binned = self._bin(x)
        self.base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        score, self.trees = np.full(n, self.base), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node, splits = np.zeros(n, dtype=np.int64), []
            for level in range(self.depth):
                cells = 1 << level
                at = ((node[:, None] * width + np.arange(width)) * self.bins + binned).ravel()
                gs, hs = (np.bincount(at, np.repeat(v, width), cells * width * self.bins).reshape(cells, width, self.bins) for v in (g, h))
                gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                best = gain.reshape(cells, -1).argmax(axis=1)
                feature, cut = best // self.bins, best % self.bins
                cut = np.where(gain.reshape(cells, -1)[np.arange(cells), best] > 1e-6, cut, self.bins)
                splits.append((feature, cut))
                node = node * 2 + (binned[np.arange(n), feature[node]] > cut[node])
            leaves = 1 << self.depth
            value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            score += value[node]
            self.trees.append((splits, value))
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)]).astype(np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        binned, out = self._bin(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for splits, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for feature, cut in splits:
                node = node * 2 + (binned[rows, feature[node]] > cut[node])
            out += value[node]
        return out


class Model:
    """Lexicon, trees and calibration; small, and sent to the workers with the tasks."""

    def __init__(self, lexicon: tuple[np.ndarray, np.ndarray], trees: Boosted, knots: tuple[np.ndarray, np.ndarray]) -> None:
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        """The isotonic value, moved a little along the raw score so that documents of one step keep their order."""
        spread = 1 / (1 + np.exp(-raw))
        return np.clip(0.98 * np.interp(raw, *self.knots) + 0.02 * spread, 0, 1)


def _stem_counts(rows: DataFrame) -> DataFrame:
    """toxic and clean documents that have a bucket, for each fold."""
    size = 1 << BUCKET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((FOLDS, 2, size), dtype=np.int32)
        memo: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            for text, label, f in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = []
                for word in set((text or "").split()):
                    if (got := memo.get(word)) is None:
                        core, _ = plain(word)
                        got = np.array([bucket(s) for s in stems(core)] if core else [], dtype=np.int64)
                        if len(memo) < 100_000:
                            memo[word] = got
                    found.append(got)
                if found:
                    counts[f, int(label > 0.5), np.unique(np.concatenate(found))] += 1
        for f in range(FOLDS):
            at = np.flatnonzero(counts[f, 1])  # clean documents matter only for buckets of toxic ones, of any task
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), f), pa.int32()), pa.array(at, pa.int32()), pa.array(counts[f, 1, at], pa.int64()), pa.array(counts[f, 0, at], pa.int64())], names=["fold", "bucket", "toxic", "clean"])
            at = np.flatnonzero((counts[f, 1] == 0) & (counts[f, 0] > 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), f), pa.int32()), pa.array(at, pa.int32()), pa.array(np.zeros(len(at)), pa.int64()), pa.array(counts[f, 0, at], pa.int64())], names=["fold", "bucket", "toxic", "clean"])

    made = rows.select("text", "label", "fold").mapInArrow(run, "fold int, bucket int, toxic long, clean long")
    return made.groupBy("fold", "bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _lexicon(counts: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with a high share of toxic documents, and their log odds against the average. counts: bucket, toxic, clean."""
    bucket_, toxic, clean = counts
    odds = np.log((toxic + 0.3) / (clean + 0.3)) - np.log((classes[1] + 1) / (classes[0] + 1))
    good = (toxic >= 3) & (odds > 2.0)
    return bucket_[good].astype(np.int64), odds[good]


def fit(docs: DataFrame, labels: DataFrame, usable: Column, most: int = labelled.MAX_LABELLED) -> Model:
    """Learns from about `most` labelled documents at most, of which usable (a condition on doc_id) holds."""
    prepare(docs.sparkSession)
    rows = labelled.sample(docs, labels, "toxic", usable, most).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("lexicon")), F.lit(FOLDS)).cast("int"))
    found = _stem_counts(rows).where("toxic > 0").toPandas()  # buckets are of a fixed number
    sizes = {(int(f), int(c)): int(n) for f, c, n in rows.groupBy("fold", (F.col("label") > 0.5).cast("int")).count().collect()}

    def lexicon(without: int | None) -> tuple[np.ndarray, np.ndarray]:
        part = found[found["fold"] != without].groupby("bucket", as_index=False)[["toxic", "clean"]].sum()
        classes = np.array([sum(n for (f, c), n in sizes.items() if c == k and f != without) for k in (0, 1)])
        return _lexicon(part[["bucket", "toxic", "clean"]].to_numpy(dtype=np.float64).T, classes)

    lexicons = [lexicon(f) for f in range(FOLDS)]

    def features(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        of = np.array(batch.column(batch.schema.get_field_index("fold")).to_pylist())
        texts = [(x or "").encode() for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        out = np.zeros((len(texts), len(FEATURES)))
        for f in np.unique(of):
            at = np.flatnonzero(of == f)
            out[at] = Featurizer(*lexicons[f])([texts[i] for i in at])
        return {"x": pa.array(out.tolist(), pa.list_(pa.float64()))}

    made = with_columns(rows, features, [T.StructField("x", T.ArrayType(T.DoubleType()))], "text").select("doc_id", "label", "fold", "x").toPandas().sort_values(["doc_id", "label"])
    x = np.array(made["x"].tolist()).reshape(-1, len(FEATURES))
    y, of = made["label"].to_numpy(dtype=np.float64) > 0.5, made["fold"].to_numpy()
    raw = np.zeros(len(y))
    for f in range(FOLDS):
        if (of == f).any():
            raw[of == f] = Boosted().fit(x[of != f], y[of != f].astype(np.float64)).score(x[of == f])
    knots = isotonic(raw, y.astype(np.float64)) if len(y) else (np.array([0.0]), np.array([0.5]))
    return Model(lexicon(None), Boosted().fit(x, y.astype(np.float64)), knots)


def score(df: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Adds score (double) and predicted (int); columns of these names are replaced."""
    held: list[Featurizer] = []

    def kernel(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        if not held:
            held.append(Featurizer(*model.lexicon))
        texts = [(x or "").encode() for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        p = model.calibrated(model.trees.score(held[0](texts)))
        return {"score": pa.array(p, pa.float64()), "predicted": pa.array((p >= threshold).astype(np.int32), pa.int32())}

    return with_columns(df, kernel, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], "text")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
