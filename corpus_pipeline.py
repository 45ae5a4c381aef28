"""Cleaning of a corpus: toxic documents go, repeated lines go, one of each group of near duplicates stays, repeated passages go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns they were given. A document that loses its whole
text to an earlier one goes with it; documents that were empty before stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import jaccard, linededup, packing, substrings, toxicity
from emberline.llm.common import fold, prepare, table

ORACLE_SQL = None
#: A character that is no white space; line dedup leaves blank lines where they are.
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"


def _with_text(before: DataFrame, kept: DataFrame) -> DataFrame:
    """Puts the kept text in place of the text, and drops documents that lost all of it."""
    gone = ~F.coalesce("kept", F.lit("")).rlike(NOT_BLANK) & F.coalesce("text", F.lit("")).rlike(NOT_BLANK)
    left = kept.where(~gone).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept")))
    if "n_chars" in before.columns:
        left = left.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType))
    return left.select(*before.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(docs, linededup.remove(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicate(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(docs, substrings.remove(docs, as_text=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, remembered=100_000)  # the executors still hold what the stages before have grown to


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", drop_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What stages hand on is written to the shared folder."""
    prepare(spark)
    folder = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
