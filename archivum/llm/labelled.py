"""Bounded samples of labelled training documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivum.llm.common import training_row


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, y (0.0 or 1.0) of at most ``most`` labelled training documents, the smallest by a hash of the id.

    Rows of ``labels`` without an id or a label don't count; an id with both labels takes the mean of its rows.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y")).where("doc_id is not null and y is not null").where(training_row())
    rows = rows.groupBy("doc_id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")
