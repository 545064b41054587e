"""A corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes the documents that the one before kept; all but the last return their columns.  In every stage null
texts count as empty (and stay null), very long texts are read whole, further columns are kept as they are, and an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivum.llm import decontaminate, jaccard_join, packing, quality, substring_dedup
from archivum.llm.common import anti_join, materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with all their columns, whatever their names.

    Null and empty texts are judged as empty passages; repeated rows get the same verdict.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    column = "quality_score"
    while column in docs.columns:
        column += "_"
    return quality.score(docs, model, column).where(F.col(column) >= quality.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id (a repeated row of it goes, too).

    Rows repeat where id and text do; different texts of one id stay, and of rows without an id one of each text.
    """
    found = jaccard_join.jaccard_components(docs)
    extra = materialize(found.where("doc_id != component_id").select("doc_id").distinct(), "extra")
    kept = anti_join(docs, extra, "doc_id").select(*docs.columns)
    return kept.dropDuplicates(["doc_id", "text"])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that a smaller id has; every row stays, of texts of one id none cuts another."""
    return substring_dedup.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows without an id stay, of an id with several texts all or none."""
    found = materialize(decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return anti_join(docs, found, "doc_id").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; rows that repeat or have no id are packed each."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
