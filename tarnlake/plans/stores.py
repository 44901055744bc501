"""Queries over sinks: write, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.operators.shape import normalize_names
from tarnlake.plans.database import remote_orders
from tarnlake.plans.fixtures import FLAT_EVENTS_SQL, nested_events, new_database, table
from tarnlake.plans.registry import query
from tarnlake.plans.scans import CUSTOMER_SQL, ORDERS_SQL
from tarnlake.session import work_folder
from tarnlake.sinks.files import append_batches, append_once, read_appended, save_delimited, save_parquet
from tarnlake.sinks.tables import ingest, save_table
from tarnlake.sinks.transfer import copy_dataset
from tarnlake.sources.files import scan_delimited
from tarnlake.sources.jdbc import scan_jdbc_partitioned

PARTS_SQL = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"
LINES_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus, l_shipdate
               FROM lineitem"""


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus",
        "l_shipdate",
    )


@query("save_managed", PARTS_SQL)
def _managed(spark, sf_dir):
    name = f"{new_database(spark)}.part"
    save_table(table(spark, sf_dir, "part"), name)
    return spark.table(name)


@query("save_external", FLAT_EVENTS_SQL)
def _external(spark, sf_dir):
    name = f"{new_database(spark)}.event"
    save_table(nested_events(spark, sf_dir), name, path=work_folder(spark))
    return spark.table(name).select("event_id", "itemId", "quantity", "price", "baseProperties.*")


@query("save_in_database", CUSTOMER_SQL)
def _in_database(spark, sf_dir):
    database = new_database(spark)
    save_table(table(spark, sf_dir, "customer"), f"{database}.customer_in_db")
    return spark.sql("SELECT * FROM IDENTIFIER(:name)", args={"name": f"{database}.customer_in_db"})


@query("append_batches", ORDERS_SQL)
def _append(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    finished = F.col("o_orderstatus").eqNullSafe("F")
    path = work_folder(spark)
    append_batches([orders.filter(finished), orders.filter(~finished)], path)
    return spark.read.schema(orders.schema).parquet(path)


@query("append_once", ORDERS_SQL)
def _append_once(spark, sf_dir):
    """Orders by priority, in runs that overlap and are repeated."""
    orders, path = table(spark, sf_dir, "orders"), work_folder(spark)
    urgent = F.col("o_orderpriority").startswith("1")
    for batches in (orders.filter(urgent), orders.filter(urgent), orders, orders.filter(~urgent), orders):
        append_once(batches, path, "o_orderpriority")
    return read_appended(spark, path, orders.schema)


@query("save_path", LINES_SQL)
def _path(spark, sf_dir):
    path = work_folder(spark)
    save_parquet(_lines(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("save_path_partitioned", LINES_SQL)
def _path_partitioned(spark, sf_dir):
    path = work_folder(spark)
    rows = _lines(spark, sf_dir)
    save_parquet(rows, path, partition_by=["l_returnflag", "l_linestatus"])
    return spark.read.parquet(path).select(*rows.columns)


@query("save_path_rebalanced", LINES_SQL)
def _path_rebalanced(spark, sf_dir):
    path = work_folder(spark)
    rows = _lines(spark, sf_dir)
    save_parquet(rows, path, partition_by=["l_returnflag", "l_linestatus"], rebalance=True)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


@query("save_delimited", PARTS_SQL)
def _delimited(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    path = work_folder(spark)
    save_delimited(rows, path)
    return scan_delimited(spark, path, rows.schema)


@query("ingest_jdbc", ORDERS_SQL)
def _ingest(spark, sf_dir):
    options, name = remote_orders(spark, sf_dir)
    remote = scan_jdbc_partitioned(spark, options, name, "O_ORDERKEY", 10, fetch_size=1000)
    stored = ingest(normalize_names(remote), f"{new_database(spark)}.orders")
    return stored.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query("copy_dataset", "SELECT * FROM lineitem")
def _copy(spark, sf_dir):
    return copy_dataset(spark, f"{sf_dir}/lineitem.parquet", work_folder(spark))


BUCKETS_SQL = "SELECT o_orderkey, o_orderdate, lpad(CAST(o_orderkey % 20 AS VARCHAR), 4, '0') AS bucket FROM orders"


def buckets(spark, sf_dir):
    """Orders with a text column of leading zeros."""
    bucket = F.lpad((F.col("o_orderkey") % 20).cast("string"), 4, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", bucket.alias("bucket"))


@query("copy_dataset_folders", BUCKETS_SQL)
def _copy_folders(spark, sf_dir):
    path = work_folder(spark)
    save_parquet(buckets(spark, sf_dir), path, partition_by=["bucket"])
    return copy_dataset(spark, path, work_folder(spark), partition_by=["bucket"])


@query("copy_dataset_verified", ORDERS_SQL)
def _copy_verified(spark, sf_dir):
    return copy_dataset(spark, f"{sf_dir}/orders.parquet", work_folder(spark), target_format="orc", verify=True)


@query("copy_dataset_format", CUSTOMER_SQL)
def _copy_format(spark, sf_dir):
    return copy_dataset(spark, f"{sf_dir}/customer.parquet", work_folder(spark), target_format="json")
