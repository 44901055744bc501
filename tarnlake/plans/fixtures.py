"""Input shapes derived from the given tables, and fresh places to write to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions.time import epoch_millis
from tarnlake.session import work_folder
from tarnlake.sinks.tables import create_database


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an item, amounts and a struct of base properties."""
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        F.concat(F.lit("sku-"), F.col("user_id")).alias("itemId"),
        (F.col("event_id") % 5).alias("quantity"),
        F.round(F.col("value") * 100).cast("bigint").alias("price"),
        F.struct(
            F.concat(F.lit("visitor-"), F.col("user_id")).alias("uid"),
            F.col("event_type").alias("eventType"),
            F.lit("3.1").alias("version"),
            epoch_millis(F.col("ts")).alias("ts"),
        ).alias("baseProperties"),
    )


# The same rows, flat, in SQL.
FLAT_EVENTS_SQL = """
SELECT event_id, 'sku-' || user_id AS "itemId", event_id % 5 AS quantity,
       CAST(round(value * 100) AS BIGINT) AS price, 'visitor-' || user_id AS uid,
       event_type AS "eventType", '3.1' AS version, epoch_us(ts) // 1000 AS ts
FROM events
"""


def new_database(spark: SparkSession) -> str:
    """A database of its own for one query run, stored in the shared work folder."""
    name = f"tarn_{uuid.uuid4().hex[:12]}"
    create_database(spark, name, f"{work_folder(spark)}/{name}.db")
    return name


def metastore(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Metastore-shaped frames that grow with the data: regions as databases,
    customers as tables, orders as columns and, for some customers, parameters."""
    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders")
    nation = table(spark, sf_dir, "nation")
    databases = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("DB_ID"), F.lower("r_name").alias("NAME")
    )
    tables = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("TBL_ID"),
        F.col("n_regionkey").alias("DB_ID"),
        (F.col("c_custkey") + 1000000).alias("SD_ID"),
        F.col("c_name").alias("TBL_NAME"),
    )
    storage = customer.select(
        (F.col("c_custkey") + 1000000).alias("SD_ID"), (F.col("c_custkey") + 2000000).alias("CD_ID")
    )
    columns = orders.select(
        (F.col("o_custkey") + 2000000).alias("CD_ID"),
        F.concat(F.lit("col_"), F.col("o_orderkey")).alias("COLUMN_NAME"),
        F.lower("o_orderpriority").alias("TYPE_NAME"),
    )
    params = orders.filter(F.col("o_orderstatus") != "P").select(
        F.col("o_custkey").alias("TBL_ID"),
        F.when(F.col("o_orderstatus") == "F", "comment").otherwise("owner").alias("PARAM_KEY"),
        F.col("o_orderpriority").alias("PARAM_VALUE"),
    )
    return databases, tables, storage, columns, params


# The same in SQL, straight from the given tables: the remarks of each customer.
REMARKS_SQL = """
SELECT DISTINCT o_custkey AS tbl_id, CASE o_orderstatus WHEN 'F' THEN o_orderpriority ELSE '' END AS tbl_comment
FROM orders WHERE o_orderstatus <> 'P' AND o_custkey IN (SELECT c_custkey FROM customer)
"""
