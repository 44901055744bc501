"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before it kept, as a Parquet table, and decides over whole texts.  A stage that is lost is run
again from that table.  Run with `run`, or stage by stage with `STAGES`.

Defined cases: null texts are empty; empty texts are scored like others, are copies of each other, and match nothing; repeated rows are copies,
of which the second stage leaves one; rows without ``doc_id`` stay unless they are rejected, copies or contaminated; an empty
table gives empty tables; further columns go along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm.decontaminate import drop_contaminated
from tarnlake.llm.exact import drop_duplicates
from tarnlake.llm.near import drop_near_duplicates
from tarnlake.llm.packing_query import packed_documents
from tarnlake.llm.quality import keep_good
from tarnlake.llm.registry import table
from tarnlake.session import work_folder

#: Words of a shingle and hundredths of similarity at which documents are near duplicates.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the classifier rejects."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one of each group of documents with the same text but for white space."""
    return drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one of each group of documents linked by similar sets of shingles."""
    return drop_near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that hold a passage of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packed_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: None: SQL can't fit a classifier or encode tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the result is the last stage's."""
    folder = work_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(kept.schema).parquet(f"{folder}/{name}")
    return docs
