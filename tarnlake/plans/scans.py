"""Queries over sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarnlake.operators.shape import normalize_names
from tarnlake.plans.database import remote_customers, remote_metastore, remote_orders
from tarnlake.plans.fixtures import nested_events, new_database, table
from tarnlake.plans.registry import query
from tarnlake.session import work_folder
from tarnlake.sinks.files import save_delimited, save_json_lines, save_text
from tarnlake.sinks.tables import save_table
from tarnlake.sources.files import scan_delimited, scan_json_lines, scan_json_texts, scan_parquet, scan_text
from tarnlake.sources.jdbc import scan_jdbc, scan_jdbc_partitioned, scan_jdbc_query
from tarnlake.sources.options import scan_with_options
from tarnlake.sources.staged import staged_jdbc_scan, unload_scan
from tarnlake.sources.tables import scan_sql, scan_table
from tarnlake.sources.unload import DERBY_EXPORT, remote_unload_scan

EVENTS_SQL = "SELECT event_id, ts, user_id, event_type, value, props FROM events"
CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


@query(
    "scan_parquet",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem
       WHERE l_discount > 0.05""",
)
def _parquet(spark, sf_dir):
    rows = scan_parquet(spark, f"{sf_dir}/lineitem.parquet")
    return rows.filter("l_discount > 0.05D").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"
    )


def _events_as_json(spark, sf_dir):
    path = work_folder(spark)
    save_json_lines(table(spark, sf_dir, "events"), path)
    return path


@query("scan_jsonl", EVENTS_SQL)
def _jsonl(spark, sf_dir):
    rows = scan_json_lines(spark, _events_as_json(spark, sf_dir))
    return rows.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")


@query("scan_jsonl_declared", EVENTS_SQL)
def _jsonl_declared(spark, sf_dir):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return scan_json_lines(spark, _events_as_json(spark, sf_dir), schema)


@query("scan_json_texts", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _json_texts(spark, sf_dir):
    return scan_json_texts(table(spark, sf_dir, "events").select("event_id", "props"), "props")


@query(
    "scan_json_texts_map",
    """SELECT o_orderkey, o_orderstatus AS status, 'c' || o_custkey AS customer, o_totalprice AS price,
              CASE WHEN o_totalprice > 1000 THEN 'customer' || o_custkey END AS tag FROM orders""",
)
def _json_texts_map(spark, sf_dir):
    """Objects whose keys are ids, inferred as a map, beside fields that few texts have."""
    price = F.struct(F.col("o_totalprice").alias("price"), F.when(F.col("o_totalprice") > 1000, F.concat(F.lit("customer"), "o_custkey")).alias("tag"))
    by_customer = F.create_map(F.concat(F.lit("c"), "o_custkey"), price)
    text = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), by_customer.alias("by")))
    rows = scan_json_texts(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "text", max_fields=50)
    return rows.select("o_orderkey", "status", F.explode("by").alias("customer", "paid")).select(
        "o_orderkey", "status", "customer", "paid.price", "paid.tag"
    )


def _customers_as_text(spark, sf_dir):
    path = work_folder(spark)
    save_delimited(table(spark, sf_dir, "customer"), path)
    return path


@query("scan_delimited", CUSTOMER_SQL)
def _delimited(spark, sf_dir):
    rows = scan_delimited(spark, _customers_as_text(spark, sf_dir))
    # Inferred integers may be narrower than the originals.
    return rows.withColumns({"c_custkey": F.col("c_custkey").cast("bigint"), "c_acctbal": F.col("c_acctbal").cast("double")})


@query("scan_delimited_declared", CUSTOMER_SQL)
def _delimited_declared(spark, sf_dir):
    source = table(spark, sf_dir, "customer")
    return scan_delimited(spark, _customers_as_text(spark, sf_dir), source.schema)


@query("scan_delimited_multi_line", 'SELECT doc_id, lang, "text" FROM documents')
def _delimited_multi_line(spark, sf_dir):
    """Texts with line breaks and quotes, written and read back."""
    path = work_folder(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    save_delimited(rows, path)
    return scan_delimited(spark, path, rows.schema, multi_line=True)


@query(
    "scan_text_partitioned",
    r"""SELECT lang, regexp_replace("text", '[\r\n]', ' ', 'g') AS "value" FROM documents""",
)
def _text(spark, sf_dir):
    path = work_folder(spark)
    lines = table(spark, sf_dir, "documents").select(
        "lang", F.regexp_replace("text", r"[\r\n]", " ").alias("value")
    )
    save_text(lines, path, partition_by=["lang"])
    return scan_text(spark, path).select("lang", "value")


@query("scan_jdbc", CUSTOMER_SQL)
def _jdbc(spark, sf_dir):
    options, name = remote_customers(spark, sf_dir)
    return normalize_names(scan_jdbc(spark, options, name, fetch_size=1000)).drop("c_profile")


def _local_times(orders):
    """Timestamps as stored, without a zone."""
    return orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query("scan_jdbc_partitioned", ORDERS_SQL)
def _jdbc_partitioned(spark, sf_dir):
    options, name = remote_orders(spark, sf_dir)
    return _local_times(normalize_names(scan_jdbc_partitioned(spark, options, name, "O_ORDERKEY", 10, fetch_size=1000)))


@query(
    "scan_jdbc_text_key",
    """SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, CASE WHEN c_acctbal >= 0 THEN c_mktsegment || '/' || c_name END AS c_key
       FROM customer""",
)
def _jdbc_text_key(spark, sf_dir):
    """Ranges of texts, of which some are NULL and all others begin with one of a few words."""
    options, name = remote_customers(spark, sf_dir, keyed=True)
    source = f"(select C_CUSTKEY, C_NATIONKEY, C_ACCTBAL, C_MKTSEGMENT, nullif(C_KEY, '') as C_KEY from {name}) q"
    return normalize_names(scan_jdbc_partitioned(spark, options, source, "C_KEY", 10, fetch_size=1000))


@query(
    "scan_jdbc_query",
    "SELECT c_nationkey, count(*) AS customers, max(c_custkey) AS newest FROM customer GROUP BY c_nationkey",
)
def _jdbc_query(spark, sf_dir):
    options, name = remote_customers(spark, sf_dir)
    text = (
        f"select C_NATIONKEY, cast(count(*) as bigint) as CUSTOMERS, max(C_CUSTKEY) as NEWEST from {name} group by C_NATIONKEY"
    )
    return normalize_names(scan_jdbc_query(spark, options, text))


STAGED_SQL = """
SELECT c_custkey, c_name, c_acctbal, c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS nation
FROM customer WHERE c_acctbal > 0
"""


@query("staged_jdbc_scan", STAGED_SQL)
def _staged(spark, sf_dir):
    options, name = remote_customers(spark, sf_dir)
    rows = staged_jdbc_scan(
        spark,
        options,
        name,
        work_folder(spark),
        condition="where C_ACCTBAL > 0",
        partition_column="C_CUSTKEY",
        num_partitions=10,
        nested={"c_profile": "struct<segment:varchar(20),nation:bigint>"},
        fetch_size=1000,
    )
    return rows.select("c_custkey", "c_name", "c_acctbal", "c_profile.segment", "c_profile.nation")


@query("staged_jdbc_scan_split", STAGED_SQL)
def _staged_split(spark, sf_dir):
    """The same, ranged over a column with few values and split again where ranges are hot."""
    options, name = remote_customers(spark, sf_dir)
    rows = staged_jdbc_scan(
        spark,
        options,
        name,
        work_folder(spark),
        condition="where C_ACCTBAL > 0",
        partition_column="C_NATIONKEY",
        num_partitions=10,
        split_column="C_CUSTKEY",
        nested={"c_profile": "struct<segment:varchar(20),nation:bigint>"},
        fetch_size=1000,
    )
    return rows.select("c_custkey", "c_name", "c_acctbal", "c_profile.segment", "c_profile.nation")


@query("staged_jdbc_scan_dates", ORDERS_SQL + " WHERE o_totalprice > 1000")
def _staged_dates(spark, sf_dir):
    """Ranges of a timestamp column, hot ones split again, as many as the rows ask for."""
    options, name = remote_orders(spark, sf_dir)
    rows = staged_jdbc_scan(
        spark,
        options,
        name,
        work_folder(spark),
        condition="where O_TOTALPRICE > 1000",
        partition_column="O_ORDERDATE",
        split_column="O_ORDERKEY",
        rows_per_task=2000,
        fetch_size=1000,
    )
    return _local_times(rows)


@query(
    "scan_with_options",
    f"""SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_totalprice, o_orderstatus AS status, CAST(o_custkey AS BIGINT) AS customer
        FROM ({ORDERS_SQL}) WHERE o_totalprice > 1000""",
)
def _with_options(spark, sf_dir):
    """The format-name entry point, with declared types from a metastore in the same database."""
    options, name = remote_orders(spark, sf_dir, nested=True)
    meta = remote_metastore(spark, sf_dir, options, name)
    rows = scan_with_options(
        spark,
        "jdbc-hive",
        {
            "dbTable": f"app.{name}",
            "conditionClause": "where O_TOTALPRICE > 1000",
            "hiveJdbcUrl": options["url"],
            "hiveMetastoreUrl": meta,
            "fetchsize": "1000",
            **{key: options[k] for key, k in (("hiveJdbcUser", "user"), ("hiveJdbcPassword", "password")) if k in options},
        },
        partition_column="O_ORDERKEY",
        num_partitions=8,
        driver=options["driver"],
    )
    return rows.select("o_orderkey", "o_totalprice", "o_pair.status", "o_pair.customer")


@query(
    "unload_scan",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus
       FROM lineitem WHERE l_quantity >= 25""",
)
def _unload(spark, sf_dir):
    view = f"lineitem_{uuid.uuid4().hex[:12]}"
    table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"
    ).createOrReplaceTempView(view)
    return unload_scan(spark, view, work_folder(spark), "WHERE l_quantity >= 25")


@query("unload_jdbc_scan", ORDERS_SQL + " WHERE o_totalprice > 1000")
def _unload_jdbc(spark, sf_dir):
    """The database exports the rows itself; Spark reads the files."""
    options, name = remote_orders(spark, sf_dir)
    condition = "where O_TOTALPRICE > 1000"
    rows = remote_unload_scan(spark, options, name, work_folder(spark), DERBY_EXPORT, condition, attempts=2)
    return _local_times(rows)


@query(
    "scan_catalog",
    "SELECT * FROM supplier",
)
def _catalog(spark, sf_dir):
    name = f"{new_database(spark)}.supplier"
    save_table(table(spark, sf_dir, "supplier"), name)
    return scan_table(spark, name)


@query(
    "sql_parameters",
    "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag",
)
def _parameters(spark, sf_dir):
    view = f"lineitem_{uuid.uuid4().hex[:12]}"
    table(spark, sf_dir, "lineitem").createOrReplaceTempView(view)
    return scan_sql(
        spark,
        "SELECT l_returnflag, count(*) AS n FROM IDENTIFIER(:name) WHERE l_quantity > :low GROUP BY l_returnflag",
        {"name": view, "low": 10},
    )


@query(
    "select_nested",
    """SELECT 'sku-' || user_id AS "itemId", epoch_us(ts) // 1000 AS ts FROM events""",
)
def _select_nested(spark, sf_dir):
    return nested_events(spark, sf_dir).select("itemId", "baseProperties.ts")
