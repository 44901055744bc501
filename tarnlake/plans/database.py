"""The database the JDBC queries read.

A real one is used when the session names it:

    spark.tarnlake.jdbc.url, .driver, .user, .password

Otherwise an in-memory Derby database is opened inside the driver process.  It
is visible to that process only, so without a named database the JDBC queries
run in local sessions alone; no server is started and no port opened.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.plans.fixtures import metastore, table
from tarnlake.session import is_local

SETTING = "spark.tarnlake.jdbc."
DERBY_DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def connection(spark: SparkSession) -> dict[str, str]:
    """Connection options of the named database, or of a new in-process one."""
    url = spark.conf.get(SETTING + "url", None)
    if url:
        names = ("driver", "user", "password")
        found = {n: spark.conf.get(SETTING + n, None) for n in names}
        return {"url": url, **{n: v for n, v in found.items() if v}}
    if not is_local(spark):
        raise ValueError(f"set {SETTING}url: the in-process database is only visible to local sessions")
    return {"url": f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "driver": DERBY_DRIVER}


def load(rows: DataFrame, options: Mapping[str, str], name: str, text_type: str | None = None) -> str:
    """Write a frame to a database table, in parallel; returns the table's name there.

    ``text_type`` is the database's type for texts, by default what Spark picks.
    """
    writer = rows.write.format("jdbc").options(**options).option("dbtable", name).option("batchsize", "5000")
    texts = [f"{column} {text_type}" for column, dtype in rows.dtypes if dtype == "string"]
    if text_type and texts:
        writer = writer.option("createTableColumnTypes", ", ".join(texts))
    writer.mode("overwrite").save()
    return name


def remote_customers(spark: SparkSession, sf_dir: str, keyed: bool = False) -> tuple[dict[str, str], str]:
    """All customers in a database table, with their segment and nation also as JSON text.

    If ``keyed``, instead with a text to range over, empty where there is none.
    """
    customers = table(spark, sf_dir, "customer")
    if keyed:
        key = F.when(F.col("c_acctbal") >= 0, F.concat_ws("/", "c_mktsegment", "c_name")).otherwise("")
        return _load_new(spark, customers.withColumn("c_key", key), "customers", text_type="VARCHAR(200)")
    rows = customers.withColumn(
        "c_profile",
        F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))),
    )
    return _load_new(spark, rows, "customers")


def remote_orders(spark: SparkSession, sf_dir: str, nested: bool = False) -> tuple[dict[str, str], str]:
    """All orders in a database table, with two columns also as JSON text if nested."""
    rows = table(spark, sf_dir, "orders")
    if nested:
        pair = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))
        rows = rows.withColumn("o_pair", F.to_json(pair))
    return _load_new(spark, rows, "orders")


def remote_metastore(spark: SparkSession, sf_dir: str, options: Mapping[str, str], name: str) -> str:
    """Metastore tables that list some columns of the table ``name`` among very many others; returns their database's address.

    They have fixed names, so only an in-process database takes them.
    """
    if not options["url"].startswith("jdbc:derby:memory:"):
        raise ValueError("metastore tables are not written to a named database")
    databases, tables, storage, columns, params = metastore(spark, sf_dir)
    own = spark.range(1)
    own_columns = [("o_orderkey", "bigint"), ("o_totalprice", "double"), ("o_pair", "struct<status:string,customer:bigint>")]
    listed = F.inline(F.array(*[F.struct(F.lit(c).alias("COLUMN_NAME"), F.lit(t).alias("TYPE_NAME")) for c, t in own_columns]))
    frames = {
        "DBS": databases.unionByName(own.select(F.lit(-1).alias("DB_ID"), F.lit("app").alias("NAME"))),
        "TBLS": tables.unionByName(
            own.select(F.lit(-1).alias("TBL_ID"), F.lit(-1).alias("DB_ID"), F.lit(-1).alias("SD_ID"), F.lit(name).alias("TBL_NAME"))
        ),
        "SDS": storage.unionByName(own.select(F.lit(-1).alias("SD_ID"), F.lit(-1).alias("CD_ID"))),
        "COLUMNS_V2": columns.unionByName(own.select(F.lit(-1).alias("CD_ID"), listed)),
        "TABLE_PARAMS": params.unionByName(
            own.select(F.lit(-1).alias("TBL_ID"), F.lit("owner").alias("PARAM_KEY"), F.lit("x").alias("PARAM_VALUE"))
        ),
    }
    for key, frame in frames.items():
        load(frame, options, key, text_type="VARCHAR(200)")
    return options["url"]


def _load_new(spark, rows, prefix, text_type=None):
    options = connection(spark)
    upper = rows.toDF(*[c.upper() for c in rows.columns])
    return options, load(upper, options, f"{prefix}_{uuid.uuid4().hex[:12]}".upper(), text_type)
