"""Queries over row changes and versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarnlake import versions
from tarnlake.operators.mutate import delete_where, merge_upsert, update_where
from tarnlake.plans.fixtures import table
from tarnlake.plans.registry import query
from tarnlake.plans.scans import CUSTOMER_SQL
from tarnlake.session import work_folder

COLUMNS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"

TARGET_SQL = f"SELECT {COLUMNS} FROM customer"
SOURCE_SQL = """SELECT c_custkey + 50 AS c_custkey, c_name, c_nationkey, c_acctbal + 1000 AS c_acctbal, c_mktsegment
                FROM customer"""


def _target(spark, sf_dir):
    return table(spark, sf_dir, "customer")


def _source(spark, sf_dir):
    """All customers under shifted keys: most meet a customer, the last ones are new."""
    return table(spark, sf_dir, "customer").withColumns(
        {"c_custkey": F.col("c_custkey") + 50, "c_acctbal": F.col("c_acctbal") + 1000}
    )


UPDATED_SQL = """SELECT c_custkey, c_name, c_nationkey,
                        CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal,
                        CASE WHEN c_mktsegment = 'BUILDING' THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment
                 FROM customer"""


@query("update_where", UPDATED_SQL)
def _update(spark, sf_dir):
    return update_where(
        table(spark, sf_dir, "customer"),
        "c_mktsegment = 'BUILDING'",
        {"c_acctbal": "c_acctbal + 10", "c_mktsegment": "lower(c_mktsegment)"},
    )


@query(
    "delete_where",
    f"SELECT {COLUMNS} FROM customer WHERE NOT coalesce(c_acctbal < 0 OR c_mktsegment = 'MACHINERY', FALSE)",
)
def _delete(spark, sf_dir):
    return delete_where(table(spark, sf_dir, "customer"), "c_acctbal < 0 OR c_mktsegment = 'MACHINERY'")


MERGED_SQL = f"""SELECT {COLUMNS} FROM ({SOURCE_SQL})
                 UNION ALL
                 SELECT {COLUMNS} FROM customer WHERE c_custkey < 50"""


@query("merge_upsert", MERGED_SQL)
def _merge(spark, sf_dir):
    return merge_upsert(_target(spark, sf_dir), _source(spark, sf_dir), ["c_custkey"])


@query(
    "merge_upsert_repeated_keys",
    """SELECT o_custkey, CASE WHEN c_custkey IS NULL THEN o_orderstatus ELSE 'N' END AS o_orderstatus,
              CASE WHEN c_custkey IS NULL THEN o_orderpriority ELSE c_mktsegment END AS o_orderpriority
       FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 3000) ON o_custkey = c_custkey
       UNION ALL
       SELECT c_custkey, 'N', c_mktsegment FROM customer
       WHERE c_acctbal > 3000 AND c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def _merge_repeated(spark, sf_dir):
    """Many target rows per key: every order of a matching customer is updated."""
    target = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    source = (
        table(spark, sf_dir, "customer")
        .filter("c_acctbal > 3000")
        .select(
            F.col("c_custkey").alias("o_custkey"),
            F.lit("N").alias("o_orderstatus"),
            F.col("c_mktsegment").alias("o_orderpriority"),
        )
    )
    return merge_upsert(target, source, ["o_custkey"])


@query("versioned_write", CUSTOMER_SQL)
def _write(spark, sf_dir):
    """Two writes; the older version is still readable."""
    root = work_folder(spark)
    rows = table(spark, sf_dir, "customer")
    first = versions.write_version(rows, root)
    versions.write_version(rows.filter("c_acctbal > 0"), root)
    return versions.read_version(spark, root, first)


def _four_versions(spark, sf_dir):
    root = work_folder(spark)
    versions.write_version(_target(spark, sf_dir), root)
    versions.update_version(spark, root, "c_mktsegment = 'BUILDING'", {"c_acctbal": "c_acctbal + 10"})
    versions.delete_version(spark, root, "c_acctbal < 0")
    versions.merge_version(spark, root, _source(spark, sf_dir), ["c_custkey"])
    return root


FOUR_SQL = f"""
WITH v0 AS ({TARGET_SQL}),
v1 AS (SELECT c_custkey, c_name, c_nationkey,
              CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM v0),
v2 AS (SELECT * FROM v1 WHERE NOT c_acctbal < 0),
src AS ({SOURCE_SQL}),
v3 AS (SELECT {COLUMNS} FROM src UNION ALL
       SELECT {COLUMNS} FROM v2 WHERE c_custkey NOT IN (SELECT c_custkey FROM src))
"""


@query("versioned_latest", FOUR_SQL + "SELECT * FROM v3")
def _latest(spark, sf_dir):
    return versions.read_latest(spark, _four_versions(spark, sf_dir))


@query("version_as_of", FOUR_SQL + "SELECT * FROM v1")
def _as_of(spark, sf_dir):
    return versions.read_version(spark, _four_versions(spark, sf_dir), 1)


@query("versioned_register", FOUR_SQL + "SELECT c_mktsegment, count(*) AS n FROM v3 GROUP BY c_mktsegment")
def _register(spark, sf_dir):
    view = f"versioned_{uuid.uuid4().hex[:12]}"
    versions.register_latest(spark, _four_versions(spark, sf_dir), view)
    return spark.sql(f"SELECT c_mktsegment, count(*) AS n FROM {view} GROUP BY c_mktsegment")


@query(
    "version_history",
    FOUR_SQL
    + """
SELECT 0 AS version, 'WRITE' AS operation, '' AS parameters, count(*) AS row_count FROM v0
UNION ALL SELECT 1, 'UPDATE', 'c_mktsegment = ''BUILDING''', count(*) FROM v1
UNION ALL SELECT 2, 'DELETE', 'c_acctbal < 0', count(*) FROM v2
UNION ALL SELECT 3, 'MERGE', 'c_custkey', count(*) FROM v3
""",
)
def _history(spark, sf_dir):
    rows = versions.history(spark, _four_versions(spark, sf_dir))
    return rows.select("version", "operation", "parameters", "row_count")


@query(
    "version_diff",
    FOUR_SQL
    + """
SELECT CAST(sum(CASE WHEN a.c_custkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS inserted,
       CAST(sum(CASE WHEN a.c_custkey IS NOT NULL AND b.c_custkey IS NOT NULL
                 AND (a.c_name IS DISTINCT FROM b.c_name OR a.c_nationkey IS DISTINCT FROM b.c_nationkey
                      OR a.c_acctbal IS DISTINCT FROM b.c_acctbal OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment)
                THEN 1 ELSE 0 END) AS BIGINT) AS updated,
       CAST(sum(CASE WHEN b.c_custkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS deleted
FROM v0 a FULL JOIN v3 b ON a.c_custkey = b.c_custkey
""",
)
def _diff(spark, sf_dir):
    return versions.version_diff(spark, _four_versions(spark, sf_dir), 0, 3, ["c_custkey"])


HOT_ORDERS_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS o_custkey, o_orderstatus, o_orderdate
                    FROM orders"""


@query(
    "versioned_merge_orders",
    f"""
WITH t AS ({HOT_ORDERS_SQL}),
s AS (SELECT CAST(-2 AS BIGINT) AS o_orderkey, c_custkey AS o_custkey, c_mktsegment AS o_orderstatus, CAST(NULL AS TIMESTAMP) AS o_orderdate
      FROM customer WHERE c_acctbal > 3000
      UNION ALL SELECT -3, -1, 'HOT', NULL)
SELECT CASE WHEN s.o_custkey IS NULL THEN t.o_orderkey ELSE s.o_orderkey END AS o_orderkey, t.o_custkey,
       CASE WHEN s.o_custkey IS NULL THEN t.o_orderstatus ELSE s.o_orderstatus END AS o_orderstatus,
       CASE WHEN s.o_custkey IS NULL THEN t.o_orderdate ELSE s.o_orderdate END AS o_orderdate
FROM t LEFT JOIN s ON t.o_custkey = s.o_custkey
UNION ALL SELECT * FROM s WHERE o_custkey NOT IN (SELECT o_custkey FROM t)
""",
)
def _merge_orders(spark, sf_dir):
    """Orders of which a third share one customer, merged with customers and that one."""
    root = work_folder(spark)
    hot = F.when(F.col("o_orderkey") % 3 == 0, F.lit(-1)).otherwise(F.col("o_custkey"))
    orders = table(spark, sf_dir, "orders").withColumn("o_custkey", hot.cast("bigint"))
    versions.write_version(orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"), root)
    none = F.lit(None).cast("timestamp_ntz").alias("o_orderdate")
    customers = table(spark, sf_dir, "customer").filter("c_acctbal > 3000")
    source = customers.select(
        F.lit(-2).cast("bigint").alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"),
        F.col("c_mktsegment").alias("o_orderstatus"), none,
    ).unionByName(
        spark.range(1).select(
            F.lit(-3).cast("bigint").alias("o_orderkey"), F.lit(-1).cast("bigint").alias("o_custkey"),
            F.lit("HOT").alias("o_orderstatus"), none,
        )
    )
    versions.merge_version(spark, root, source, ["o_custkey"])
    return versions.read_latest(spark, root)


@query(
    "version_diff_new_column",
    """SELECT CAST(0 AS BIGINT) AS inserted, count(*) FILTER (c_mktsegment = 'BUILDING' AND c_acctbal > 0) AS updated,
              count(*) FILTER (NOT c_acctbal > 0) AS deleted FROM customer""",
)
def _diff_new_column(spark, sf_dir):
    root = work_folder(spark)
    rows = table(spark, sf_dir, "customer")
    versions.write_version(rows, root)
    note = F.when(F.col("c_mktsegment") == "BUILDING", F.lower("c_mktsegment"))
    versions.write_version(rows.filter("c_acctbal > 0").withColumn("note", note), root)
    return versions.version_diff(spark, root, 0, 1, ["c_custkey"])


@query(
    "version_diff_wider_type",
    """SELECT count(*) FILTER (o_orderstatus = 'P') AS inserted, count(*) FILTER (o_orderstatus = 'F') AS updated,
              CAST(0 AS BIGINT) AS deleted FROM orders""",
)
def _diff_wider_type(spark, sf_dir):
    """Orders stored with an integer key and price, and again with wider ones, some prices changed by a fraction."""
    root = work_folder(spark)
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("int").alias("o_orderkey"), F.col("o_totalprice").cast("int").alias("price"), "o_orderstatus"
    )
    versions.write_version(orders.filter("o_orderstatus <> 'P'"), root)
    price = F.when(F.col("o_orderstatus") == "F", F.col("price") + F.lit("0.5").cast("decimal(2,1)")).otherwise(F.col("price"))
    versions.write_version(
        orders.withColumns({"o_orderkey": F.col("o_orderkey").cast("bigint"), "price": price.cast("decimal(18,2)")}), root
    )
    return versions.version_diff(spark, root, 0, 1, ["o_orderkey"])
