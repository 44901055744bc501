"""Aggregates and one-row-per-key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.operators.shape import quoted

# Step sizes of the two-dimensional low-discrepancy sequence,
# in units of 1 / SEQUENCE_UNIT.
SEQUENCE_STEP_X = 7548776662
SEQUENCE_STEP_Y = 5698402909
SEQUENCE_UNIT = 10_000_000_000

# Counters of a frequent-items sketch for each key that may hold a share; its error is at most 3.5 rows in as many as it has
# places, which are a third more.  And the smallest share, for the most counters that Spark's sketch takes.
SKETCH_FACTOR = 15
LEAST_SHARE = 0.0001


def sum_reduce(df: DataFrame, column: str, into: str = "total") -> DataFrame:
    """Sum of one column."""
    return df.agg(F.sum(column).alias(into))


def count_rows(df: DataFrame, into: str = "rows") -> DataFrame:
    """Number of rows; a Parquet scan below reads no column for it."""
    return df.agg(F.count(F.lit(1)).alias(into))


def total_length(df: DataFrame, column: str = "value", into: str = "total_chars", utf16: bool = False) -> DataFrame:
    """Length of all texts together, in characters, or in UTF-16 units as the JVM counts them."""
    length = F.octet_length(F.encode(column, "UTF-16BE")) / 2 if utf16 else F.length(column)
    return df.agg(F.sum(length.cast("bigint")).alias(into))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    The order must be total within a key for a repeatable result.  Spark
    limits every task to one row per key before the shuffle (a group limit
    below the window), so a key with very many rows reaches the last stage as
    one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def pi_estimate(df: DataFrame, index: Column | str) -> DataFrame:
    """Pi from the share of points inside the unit circle, one point per row.

    The points come from a low-discrepancy sequence instead of a random
    generator, so a run can be repeated exactly, also after a lost task.  Coordinates
    have ten digits, so indexes that are 10,000,000,000 apart give the same point.
    """
    i = (F.col(index) if isinstance(index, str) else index).cast("bigint")
    x = _coordinate(i, SEQUENCE_STEP_X)
    y = _coordinate(i, SEQUENCE_STEP_Y)
    inside = F.when(x * x + y * y <= 1, 1).otherwise(0)
    return df.agg(F.count(F.lit(1)).alias("points"), F.sum(inside).alias("inside")).select(
        "points", "inside", (F.lit(4.0) * F.col("inside") / F.col("points")).alias("pi")
    )


def partition_sizes(df: DataFrame) -> DataFrame:
    """Rows per partition of a frame: shows skew.  Empty partitions are not listed."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("rows"))


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """The keys that hold at least ``share`` of all rows, with their exact ``rows``: what makes a partition heavy.

    A first pass keeps a sketch of frequent items, put together from sketches of the tasks: `SKETCH_FACTOR` / ``share`` counters
    each, whatever the number of keys, with an error below a fifth of the share.  So no key of that share is missing from its first
    2 / ``share`` items.  A second pass counts these exactly.  NULL is a key too.
    """
    if not LEAST_SHARE <= share <= 1:
        raise ValueError(f"a share is {LEAST_SHARE} at least and 1 at most, not {share}")
    columns = [F.col(quoted(k)) for k in keys]
    # A hash stands for a key: keys with one hash are candidates together, and counted apart.
    hashed = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    listed, tracked = math.ceil(2 / share), math.ceil(SKETCH_FACTOR / share)
    sketch = F.expr(f"approx_top_k(_key, {listed}, {tracked})")
    top = df.select(hashed.alias("_key")).agg(sketch.alias("top"), F.count(F.lit(1)).alias("_all"))
    likely = top.select("_all", F.explode("top").alias("t")).select(F.col("t.item").alias("_key"), "_all")
    # The candidates are 2 / share rows at most, whatever the input.
    counted = df.select(*columns, hashed.alias("_key")).join(F.broadcast(likely), "_key")
    counted = counted.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"), F.max("_all").alias("_all"))
    return counted.filter(F.col("rows") >= F.lit(float(share)) * F.col("_all")).drop("_all")


def _coordinate(i: Column, step: int) -> Column:
    # i * step modulo the unit, with the step in two halves so that no product leaves 64 bits.
    half = 100_000
    unit = F.lit(SEQUENCE_UNIT)
    rest = F.pmod(i, unit)
    upper = F.pmod(rest * F.lit(step // half), unit)
    product = F.pmod(upper * F.lit(half) + rest * F.lit(step % half), unit)
    return product.cast("double") / F.lit(float(SEQUENCE_UNIT)) * 2 - 1
