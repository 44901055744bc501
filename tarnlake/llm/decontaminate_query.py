"""Query 3: passages of benchmark items in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm.decontaminate import find_matches
from tarnlake.llm.registry import query, table


@query("op3_simhash_decontamination")
def simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
