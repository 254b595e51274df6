"""The corpus pipeline: quality selection, exact and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last
return the columns of ``documents``. ``run`` writes every stage's rows as Parquet to the shared
folder and hands the reread table on, so that a lost executor costs a stage's tasks and no more.

Every stage takes null texts as empty, nulls in any other column, rows that repeat, extra columns of any name (they are
carried through the first four) and tables without rows (and returns none). What a null doc_id means is said with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspan.llm import exact_dedup, mixing, near_dedup, packing, quality
from tallyspan.llm.common import load, staged


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the well-labelled ones selects.

    An empty text has weight 0; a null id has no label and noise of its own; rows that repeat an id are chosen each by
    its own text. Without labels of both kinds all stay. Texts are scored twice, for the level and where they
    lie: writing them with their scores would cost more than it saves.
    """
    return quality.select_documents(docs, load(spark, sf_dir, "labels"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; null and empty texts are equal; a null id stays only where it is alone."""
    return exact_dedup.drop_copies(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id; texts without words and null ids are in no group and stay."""
    return near_dedup.drop_near_copies(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for; null is a source of its own, the last."""
    return mixing.mix(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences; an empty text is its closing id alone, a null id is carried along."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_deduplication", exact_deduplication),
    ("near_deduplication", near_deduplication),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: SQL can express neither the classifier nor the packing: the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
