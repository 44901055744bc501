"""Query 5: exact duplicates among all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import exact
from tarnlake.llm.registry import query, table


@query(
    "op5_msd_radix_dedup",
    """
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS n FROM documents
    ), w AS (
        SELECT *, first(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size
        FROM d
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM w
    """,
)
def msd_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digested = docs.withColumn("text_sha256", F.sha2(exact.strip(F.col("text")).cast("binary"), 256))
    marked = exact.mark_duplicates(digested, ["doc_id", "text_sha256"])
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
