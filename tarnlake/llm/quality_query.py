"""Query 4: the quality of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm.quality import score_documents
from tarnlake.llm.registry import query, table


@query("op4_rule_ensemble_quality")
def rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
