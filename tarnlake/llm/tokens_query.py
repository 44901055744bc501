"""Query 9: token counts of all documents, from a new cache."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import tokens
from tarnlake.llm.registry import query, table
from tarnlake.session import work_folder

LIMIT = 2048


@query("op9_digest_cached_token_counts")
def digest_cached_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(
        table(spark, sf_dir, "documents"),
        work_folder(spark),
        public_tokenizers.path("word_bpe_49k.json"),
        tokens.single_blanks,
    )
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
