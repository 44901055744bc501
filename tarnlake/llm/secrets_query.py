"""Query 2: secrets in all documents.

The forest learns from drawn examples and, of the findings in the documents, from those whose form proves what they are: keys of a provider's
fixed format are secrets; runs of letters alone, or of digits alone, that nothing is assigned to are not.  All others, those assigned to a
telling name included, are left to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import secrets
from tarnlake.llm.registry import query, table
from tarnlake.session import work_folder


def labelled(findings: DataFrame) -> DataFrame:
    """Adds ``label``: 1, 0, or null where the form proves nothing."""
    number = {name: F.col("features")[i] for i, name in enumerate(secrets.FEATURES)}
    mixed = number["digits"].between(0.05, 0.95)
    key = (F.col("kind") == "loose") & (F.col("length") == 20) & (number["uppers"] + number["digits"] > 0.999) & mixed
    plain = (F.col("kind") == "loose") & ((number["digits"] == 0) | (number["digits"] == 1))
    return findings.withColumn("label", F.when(key, 1).when(plain, 0))


def trained(found: DataFrame, language: secrets.Language):
    """The forest, from drawn examples and the findings whose form is proof."""
    drawn = secrets.example_findings(found.sparkSession, language).select("features", "label")
    # Their number is bounded, those in the documents by `MOST_FINDINGS`.
    return secrets.train(drawn.unionByName(labelled(found).select("features", "label")))


@query("op2_forest_secret_scan")
def forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    language = secrets.learn_language(docs)
    found = secrets.find_candidates(docs, language, "source")
    path = work_folder(spark)
    found.write.parquet(path)
    found = spark.read.schema(secrets.SCHEMA).parquet(path)
    model = trained(found, language)
    return secrets.judge(found, model).withColumn("is_secret", F.col("probability") >= 0.5)
