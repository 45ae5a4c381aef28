"""Quality: regularised quadratic discriminant analysis of transformed document statistics.

Each class has a mean and a covariance shrunk towards its diagonal and towards the pooled one; the score comes from the difference of the
Mahalanobis log densities, with Cholesky factors computed once, and is calibrated by an isotonic curve on documents kept out of the fit. A
null or empty text has the statistics of no words and gets a score like any other. Rows are scored one by one, so rows that repeat stay as many with
equal scores, and other columns pass through; without labels every score is a half. Of several labels of one document the largest holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import labelled
from .common import fold, table, with_columns
from .words import WordTable, byte_counts, isotonic, sums

#: Function words of the languages in common use here, a fixed list.
FUNCTION_WORDS = frozenset("the of and to in is was that it for on as with be by at this an a from are or der die das und ist nicht mit auf für von zu im den ein eine sich auch es le la les un une de des et est que qui dans pour par sur avec du au en el los las una y por con del se su al lo como más".split())
STATISTICS = ("words", "word_length", "distinct", "function", "upper_words", "marked_words", "digits", "upper", "marks", "spaces", "rare_marks", "lines", "line_words", "distinct_lines", "entropy", "ended_lines")


def _describe(words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), 4), dtype=np.float32)
    for i, w in enumerate(words):
        core = w.strip(".,;:!?\"'()")
        out[i] = len(w), core.lower() in FUNCTION_WORDS, len(core) > 1 and core.isupper(), not core.isalpha()
    return out


class Statistics:
    """Statistics of texts, transformed to be nearer to normal."""

    def __init__(self) -> None:
        self.table = WordTable(_describe)

    def __call__(self, texts: list[str]) -> np.ndarray:
        parts = [x.split() for x in texts]
        counts = np.array([len(x) for x in parts], dtype=np.int64)
        total = sums(self.table.look_up([w for x in parts for w in x]), counts)
        n = np.maximum(counts, 1)
        b = byte_counts([x.encode() for x in texts])
        size = np.maximum(b.sum(axis=1), 1)
        p = b / size[:, None]
        entropy = -(p * np.log2(np.maximum(p, 1e-12))).sum(axis=1)
        upper, lower, digits = b[:, 65:91].sum(axis=1), b[:, 97:123].sum(axis=1), b[:, 48:58].sum(axis=1)
        usual = b[:, [44, 46]].sum(axis=1)
        marks = b[:, 33:48].sum(axis=1) + b[:, 58:65].sum(axis=1) + b[:, 91:97].sum(axis=1) + b[:, 123:127].sum(axis=1) - usual
        lines = [[y for y in x.split("\n") if y] for x in texts]
        n_lines = np.array([len(x) for x in lines])
        distinct_lines = np.array([len(set(x)) for x in lines])
        ended = np.array([sum(y[-1] in ".!?" for y in x) for x in lines])
        share = lambda a, c: np.log((a + 0.5) / (np.maximum(c - a, 0) + 0.5))  # noqa: E731  log odds of a share
        distinct = np.array([len(set(x)) for x in parts])
        return np.column_stack(
            [np.log1p(counts), np.log1p(total[:, 0] / n), np.log((distinct + 1) / (n + 1)), share(total[:, 1], n), share(total[:, 2], n), share(total[:, 3], n), share(digits, size), share(upper, upper + lower + 1)]
            + [share(marks, size), share(b[:, 32], size), share(usual, size), np.log1p(n_lines), np.log1p(n / np.maximum(n_lines, 1)), np.log((distinct_lines + 1) / (n_lines + 1)), entropy, share(ended, np.maximum(n_lines, 1))]
        )


class Discriminant:
    def __init__(self, shrink: float = 0.1, pooled: float = 0.2) -> None:
        self.shrink, self.pool = shrink, pooled

    def fit(self, x: np.ndarray, y: np.ndarray) -> Discriminant:
        width = x.shape[1]
        self.centre = x.mean(axis=0) if len(x) else np.zeros(width)
        self.scale = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(width)
        z = (x - self.centre) / self.scale
        overall = np.cov(z.T, bias=True) if len(z) > 1 else np.eye(width)
        self.classes = []
        for k in (0, 1):
            part = z[y == k]
            mean = part.mean(axis=0) if len(part) else np.zeros(width)
            own = np.cov(part.T, bias=True) if len(part) > 1 else overall
            cov = (1 - self.pool) * own + self.pool * overall
            cov = (1 - self.shrink) * cov + self.shrink * np.diag(np.maximum(np.diag(cov), 1e-2)) + 1e-3 * np.eye(width)
            factor = np.linalg.cholesky(cov)
            self.classes.append((mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()), float(np.log((len(part) + 1) / (len(z) + 2)))))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        density = [prior - half - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, half, prior in self.classes]
        return density[1] - density[0]


class Model:
    def __init__(self, parts: list[Discriminant], knots: tuple[np.ndarray, np.ndarray]) -> None:
        self.parts, self.knots = parts, knots

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = squeeze(np.mean([m.score(x) for m in self.parts], axis=0))
        return np.clip(0.98 * np.interp(raw, *self.knots) + 0.02 / (1 + np.exp(-raw)), 0, 1)


def squeeze(d: np.ndarray) -> np.ndarray:
    """Log-density differences of far-off documents are huge; their order stays."""
    return np.sign(d) * np.log1p(np.abs(d))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, most: int = labelled.MAX_LABELLED) -> Model:
    """Learns from about `most` labelled documents at most, of which usable (a condition on doc_id) holds."""
    made = statistics(labelled.sample(docs, labels, "quality", usable, most)).select("doc_id", "label", "x").toPandas().sort_values(["doc_id", "label"])
    x = np.array(made["x"].tolist()).reshape(-1, len(STATISTICS))
    y = (made["label"].to_numpy(dtype=np.float64) > 0.5).astype(np.int64)
    if not len(y):
        return Model([Discriminant().fit(x, y)], (np.array([0.0]), np.array([0.5])))
    part = np.arange(len(y)) % 4
    raw = np.zeros(len(y))
    for k in range(4):
        if (part == k).any() and (part != k).any():
            raw[part == k] = Discriminant().fit(x[part != k], y[part != k]).score(x[part == k])
    return Model([Discriminant().fit(x, y)], isotonic(squeeze(raw), y.astype(np.float64)))


def statistics(df: DataFrame) -> DataFrame:
    """Adds x, the statistics of text in the order of STATISTICS; a column x is replaced."""
    held: list[Statistics] = []

    def kernel(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        if not held:
            held.append(Statistics())
        x = held[0]([t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])
        return {"x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float64()), len(STATISTICS)).cast(pa.list_(pa.float64()))}

    return with_columns(df, kernel, [T.StructField("x", T.ArrayType(T.DoubleType()))], "text")


def score(df: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Adds score (double) and predicted (int); columns of these names are replaced."""
    held: list[Statistics] = []

    def kernel(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        if not held:
            held.append(Statistics())
        p = model.score(held[0]([t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]))
        return {"score": pa.array(p, pa.float64()), "predicted": pa.array((p >= threshold).astype(np.int32), pa.int32())}

    return with_columns(df, kernel, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], "text")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
