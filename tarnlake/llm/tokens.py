"""Token counts through a cache of digests: a text is encoded only if no equal text has been, now or in earlier runs.

The cache is a Parquet folder of ``(content, tokenizer, n_tokens)``: the SHA-256 of a normalised text, the SHA-256 of
the vocabulary file and the encoder's settings, and the count.  A run digests all texts, keeps the digests that the cache lacks,
picks one row for each, encodes the texts of these rows alone, and appends their counts.  Then every row takes its
count from the cache.  Only the texts of misses are shuffled, and by row, so that a text with very many copies crosses as one.

An append is committed as a whole by Spark's writer.  Two runs at once may both append a count, which are then equal; reading takes
one of each.

Defined cases: a null text is empty; a null ``doc_id`` is kept; repeated rows are counted each and encoded once; an
empty table gives no rows and appends none.  Further columns are not carried, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.encoding import CountEncoder, slices, worker_encoder
from tarnlake.session import work_folder

CACHE_SCHEMA = "content binary, tokenizer binary, n_tokens bigint"
#: Part of the tokenizer's digest, to be changed with anything here that changes a count.
SETTINGS = "no added specials, no truncation"
#: Stands for a null id where one row is chosen among equal texts.
NAMELESS = -(1 << 63)


def as_is(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def single_blanks(text: Column) -> Column:
    """Runs of blanks and line ends as one blank, for vocabularies that drop white space."""
    return F.regexp_replace(as_is(text), "(?:[\\t\\n\\r]| (?=[ \\t\\n\\r]))[ \\t\\n\\r]*", " ")


def tokenizer_digest(path: str) -> bytes:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + SETTINGS.encode()).digest()


def read_cache(spark: SparkSession, cache: str, tokenizer: bytes) -> DataFrame:
    """``content`` and ``n_tokens`` of one tokenizer, once for each content."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    of_this = stored.where(F.col("tokenizer") == F.lit(tokenizer))
    return of_this.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, cache: str, tokenizer: str, normalise=as_is) -> None:
    """Encode the texts of ``docs`` that the cache lacks and append their counts."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NAMELESS)).alias("row"), normalise(F.col("text")).alias("text")
    ).withColumn("content", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    known = read_cache(spark, cache, version)
    misses = rows.groupBy("content").agg(F.min("row").alias("row")).join(known, "content", "left_anti")

    def encoded(batches):
        encoder = worker_encoder(CountEncoder, tokenizer)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [n for a, b in slices(texts) for n in encoder.counts(texts[a:b])]
            yield pa.RecordBatch.from_pydict({"content": batch.column("content"), "n_tokens": pa.array(counts, pa.int64())})

    chosen = rows.join(misses.hint("shuffle_hash"), ["content", "row"])
    counts = chosen.select("content", "text").mapInArrow(encoded, "content binary, n_tokens bigint")
    once = counts.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    once.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, normalise=as_is) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``n_tokens`` of every row.

    ``cache`` is a folder that all executors share, ``tokenizer`` a vocabulary file that each of them has.
    ``normalise`` may join texts that the tokenizer can't tell apart.
    """
    fill_cache(docs, cache, tokenizer, normalise)
    spark = docs.sparkSession
    # Written once more, one row for each content: a join with plain rows can be split where one content has very many.
    folder = work_folder(spark)
    known = read_cache(spark, cache, tokenizer_digest(tokenizer))
    known.write.parquet(folder)
    known = spark.read.schema(known.schema).parquet(folder)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.octet_length(as_is(F.col("text"))).cast("bigint").alias("n_bytes"),
        F.unhex(F.sha2(normalise(F.col("text")).cast("binary"), 256)).alias("content"),
    )
    return rows.join(known, "content", "left").select("doc_id", "n_bytes", "n_tokens")
