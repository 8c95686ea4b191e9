"""The corpus pipeline: quality rules, line dedup, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of documents. ``run`` writes each stage's result as Parquet, reads it again and deletes the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalmark.llm import line_dedup, minhash, packing, pii, quality
from shoalmark.llm.common import drop, keep, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or look unusual to the forest."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_line_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one line of each group of near-equal lines; documents without any line left go."""
    return line_dedup.dedup(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five words, similarity 0.8."""
    gone = minhash.near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in full sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("lines", one_line_each),
    ("near_duplicates", one_of_each_group),
    ("personal_data", no_personal_data),
    ("packing", packed),
]

#: Trees, components and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        was, docs = docs, keep(stage(spark, docs, sf_dir), name)
        drop(was)
    return docs
