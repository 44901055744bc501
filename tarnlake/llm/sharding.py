"""Contiguous shards of nearly equal size: global prefix sums of sizes, cut at equal targets.

Rows are put in one order by a range partitioning of their names and sizes alone; texts don't move.  Each partition's
total is summed, the totals are summed over the partitions, and a row's place among all bytes is its partition's start
plus the sum within the partition.  A row goes to the shard that holds its middle byte, so every shard is within one
row of its target at either end.

Defined cases: a null text has no bytes; null ids come first; rows that tie in id and size come in the order of their content's checksum
and then as read; repeated rows each have a place of their own, however many; an empty table gives no rows; of fewer rows than
shards, or of rows larger than a target, some shards stay empty.  Further columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.session import work_folder

#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: Rows of one partition of the order.
ROWS_PER_PARTITION = 1_000_000


def _row_sums(ordered: DataFrame) -> DataFrame:
    """Adds ``first_byte`` and ``place``, a row's sums of bytes and rows before it, over all partitions."""
    totals = ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # One row per partition: the only sum that a single task makes.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
    )
    within = Window.partitionBy("part").orderBy("at")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    return (
        ordered.withColumns(
            {"b": F.coalesce(F.sum("size").over(before), F.lit(0)), "r": F.row_number().over(within) - F.lit(1)}
        )
        .join(starts, "part")
        .withColumns({"first_byte": F.col("bytes_before") + F.col("b"), "place": F.col("rows_before") + F.col("r")})
        .drop("b", "r", "bytes_before", "rows_before")
    )


def assign_shards(docs: DataFrame, shards: int) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` (its place within the shard) of every row."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    sizes = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("seen"),
    )
    folder = work_folder(spark)
    sizes.write.parquet(f"{folder}/sizes")
    sizes = spark.read.parquet(f"{folder}/sizes")
    count, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    order = ["doc_id", "size", "text_crc32", "seen"]
    parts = max(1, min(count // 1000, max(spark.sparkContext.defaultParallelism, count // ROWS_PER_PARTITION)))
    # Written, so that rows keep the partition and place that the totals were made of.
    sizes.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns(
        {"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}
    ).write.parquet(f"{folder}/ordered")
    placed = _row_sums(spark.read.parquet(f"{folder}/ordered"))
    wide = "decimal(38,0)"
    middle = (F.col("first_byte") * 2 + F.col("size")).cast(wide)
    shard = F.expr("least(n - 1, (middle * n) div whole)")
    with_shard = placed.withColumns(
        {"middle": middle, "n": F.lit(shards).cast(wide), "whole": F.lit(max(1, 2 * total)).cast(wide)}
    ).withColumn("shard", shard.cast("int"))
    # One row per shard.
    firsts = with_shard.groupBy("shard").agg(F.min("place").alias("first_place"))
    return with_shard.join(firsts, "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first_place")).alias("slot")
    )
