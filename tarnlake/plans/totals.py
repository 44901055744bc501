"""Queries over aggregates, one-row-per-key and partitioning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnlake.operators.shape import flatten_struct
from tarnlake.operators.summarize import (
    count_rows,
    first_per_key,
    heavy_keys,
    partition_sizes,
    pi_estimate,
    sum_reduce,
    total_length,
)
from tarnlake.plans.fixtures import FLAT_EVENTS_SQL, nested_events, table
from tarnlake.plans.registry import query


@query("sum_reduce", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def _sum(spark, sf_dir):
    return sum_reduce(table(spark, sf_dir, "lineitem"), "l_linenumber")


@query("count_rows", 'SELECT count(*) AS "rows" FROM lineitem')
def _count(spark, sf_dir):
    return count_rows(table(spark, sf_dir, "lineitem"))


@query("total_length", """SELECT CAST(sum(length("text")) AS BIGINT) AS total_chars FROM documents""")
def _total_length(spark, sf_dir):
    return total_length(table(spark, sf_dir, "documents"), "text")


@query(
    "total_length_utf16",
    r"""SELECT CAST(sum(length("text") + length(regexp_replace("text", '[\x{0}-\x{FFFF}]', '', 'g'))) AS BIGINT)
              AS total_units FROM documents""",
)
def _total_length_utf16(spark, sf_dir):
    return total_length(table(spark, sf_dir, "documents"), "text", into="total_units", utf16=True)


@query(
    "first_per_key",
    f"""SELECT * FROM ({FLAT_EVENTS_SQL})
        QUALIFY row_number() OVER (PARTITION BY "itemId" ORDER BY ts, event_id) = 1""",
)
def _first(spark, sf_dir):
    rows = first_per_key(nested_events(spark, sf_dir), ["itemId"], ["baseProperties.ts", "event_id"])
    return flatten_struct(rows, "baseProperties")


@query(
    "first_events_by_type",
    f"""SELECT "eventType", count(*) AS items, min(ts) AS earliest, CAST(sum(price) AS BIGINT) AS price
        FROM (SELECT * FROM ({FLAT_EVENTS_SQL})
              QUALIFY row_number() OVER (PARTITION BY "itemId" ORDER BY ts, event_id) = 1)
        GROUP BY "eventType" """,
)
def first_events_by_type(spark, sf_dir):
    """Flagship: nested events, flattened, first event per item, counted by type."""
    flat = flatten_struct(nested_events(spark, sf_dir), "baseProperties")
    return (
        first_per_key(flat, ["itemId"], ["ts", "event_id"])
        .groupBy("eventType")
        .agg(F.count(F.lit(1)).alias("items"), F.min("ts").alias("earliest"), F.sum("price").alias("price"))
    )


@query(
    "pi_estimate",
    """
WITH i AS (SELECT CAST(l_orderkey * 8 + l_linenumber AS HUGEINT) AS i FROM lineitem),
p AS (SELECT ((i * 7548776662) % 10000000000) / 10000000000.0::DOUBLE * 2 - 1 AS x,
             ((i * 5698402909) % 10000000000) / 10000000000.0::DOUBLE * 2 - 1 AS y FROM i)
SELECT count(*) AS points, CAST(sum(CASE WHEN x * x + y * y <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS inside,
       4.0::DOUBLE * sum(CASE WHEN x * x + y * y <= 1 THEN 1 ELSE 0 END) / count(*) AS pi FROM p
""",
)
def _pi(spark, sf_dir):
    return pi_estimate(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") * 8 + F.col("l_linenumber"))


@query(
    "partition_sizes",
    """SELECT CAST(unnest(range(4)) AS INTEGER) AS "partition", TRUE AS near_mean, count(*) AS all_rows FROM lineitem""",
)
def _partition_sizes(spark, sf_dir):
    """Four partitions, each within a tenth of the mean."""
    sizes = partition_sizes(table(spark, sf_dir, "lineitem").select("l_orderkey").repartition(4))
    # One row per partition.
    sizes = sizes.withColumn("all_rows", F.sum("rows").over(Window.partitionBy(F.lit(0))))
    near = F.abs(F.col("rows") * 4 - F.col("all_rows")) * 10 <= F.col("all_rows")
    return sizes.select("partition", near.alias("near_mean"), "all_rows")


HOT_PARTS_SQL = "SELECT CASE WHEN l_partkey % 4 = 0 THEN l_linenumber ELSE l_partkey END AS k, l_returnflag FROM lineitem"


@query(
    "heavy_keys",
    f"""SELECT k, l_returnflag, count(*) AS "rows" FROM ({HOT_PARTS_SQL}) GROUP BY k, l_returnflag
        HAVING count(*) >= 0.01 * (SELECT count(*) FROM lineitem)""",
)
def _heavy_keys(spark, sf_dir):
    """Keys that hold a hundredth of the rows, among very many that don't."""
    part = F.when(F.col("l_partkey") % 4 == 0, F.col("l_linenumber")).otherwise(F.col("l_partkey")).cast("bigint")
    lines = table(spark, sf_dir, "lineitem").select(part.alias("k"), "l_returnflag")
    return heavy_keys(lines, ["k", "l_returnflag"], 0.01)


@query("repartition_rows", 'SELECT CAST(4 AS BIGINT) AS partitions, count(*) AS "rows" FROM lineitem')
def _repartition(spark, sf_dir):
    sizes = partition_sizes(table(spark, sf_dir, "lineitem").select("l_orderkey").repartition(4))
    return sizes.agg(F.count(F.lit(1)).alias("partitions"), F.sum("rows").alias("rows"))
