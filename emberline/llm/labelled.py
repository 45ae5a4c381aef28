"""A bounded sample of labelled documents, from which classifiers learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier learns from, about; the rest of the labels is left unread.
MAX_LABELLED = 20_000


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text and label (double) of about `most` labelled documents at most, chosen by a hash of the id.

    Labels that are null or belong to no usable id are left out; of several labels of one document the largest holds. The chosen labels
    are few by the parameter, so they are broadcast to the documents.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).dropna().where(usable)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, most / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1_000_003)) < int(share * 1_000_003) + (share == 1.0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
