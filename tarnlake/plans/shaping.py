"""Queries over projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.functions import text
from tarnlake.operators.shape import flatten_struct, map_count, nest_columns, normalize_names, preview, project_json
from tarnlake.plans.fixtures import FLAT_EVENTS_SQL, nested_events, table
from tarnlake.plans.registry import query


@query(
    "add_columns",
    """SELECT event_id, 'sku-' || user_id || '-' || 'visitor-' || user_id AS id,
              'visitor-' || user_id AS uid, event_type AS "eventType" FROM events""",
)
def _add(spark, sf_dir):
    rows = nested_events(spark, sf_dir).withColumns(
        {
            "id": F.concat("itemId", F.lit("-"), "baseProperties.uid"),
            "uid": F.col("baseProperties.uid"),
            "eventType": F.col("baseProperties.eventType"),
        }
    )
    return rows.select("event_id", "id", "uid", "eventType")


@query(
    "rename_columns",
    """SELECT event_id, 'sku-' || user_id AS "itemKey", event_id % 5 AS amount FROM events""",
)
def _rename(spark, sf_dir):
    rows = nested_events(spark, sf_dir).withColumnsRenamed({"itemId": "itemKey", "quantity": "amount"})
    return rows.select("event_id", "itemKey", "amount")


@query(
    "drop_columns",
    """SELECT event_id, 'sku-' || user_id AS "itemId", event_id % 5 AS quantity FROM events""",
)
def _drop(spark, sf_dir):
    return nested_events(spark, sf_dir).drop("baseProperties", "price")


@query("nest_columns", "SELECT o_orderkey, o_orderstatus, o_totalprice + 1 AS price, o_custkey FROM orders")
def _nest(spark, sf_dir):
    """Columns packed into a struct, used there, and taken out again."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    nested = nest_columns(orders, ["o_totalprice", "o_custkey"], "facts")
    return nested.select("o_orderkey", "o_orderstatus", (F.col("facts.o_totalprice") + 1).alias("price"), "facts.o_custkey")


@query("flatten_struct", FLAT_EVENTS_SQL)
def _flatten(spark, sf_dir):
    return flatten_struct(nested_events(spark, sf_dir), "baseProperties")


@query("map_count", 'SELECT count(*) AS "rows" FROM lineitem')
def _map_count(spark, sf_dir):
    return map_count(table(spark, sf_dir, "lineitem"))


@query(
    "project_json",
    """SELECT c_custkey, CAST(json_object('givenName', upper(substr(n, 1, 1)) || substr(n, 2),
              'years', c_nationkey) AS VARCHAR) AS json
       FROM (SELECT c_custkey, lower(c_name) AS n, c_nationkey FROM customer)""",
)
def _json(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.lower("c_name").alias("givenName"),
        F.col("c_nationkey").alias("age"),
        F.col("c_mktsegment").alias("address"),
    )
    return project_json(people, {"givenName": None, "age": "years"}, init_upper=["givenName"]).select(
        "c_custkey", "json"
    )


@query("row_text", "SELECT o_orderkey, o_orderkey || ',' || o_custkey || ',' || o_orderstatus AS line FROM orders")
def _row_text(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", text.row_text("o_orderkey", "o_custkey", "o_orderstatus").alias("line"))


@query("normalize_names", "SELECT p_partkey AS partkey, p_brand AS brand, p_size AS size FROM part")
def _normalize(spark, sf_dir):
    remote_style = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part.PartKey"), F.col("p_brand").alias("part.BRAND"), F.col("p_size").alias("SIZE")
    )
    return normalize_names(remote_style)


@query(
    "filter_eq",
    """SELECT event_id, event_id % 5 AS quantity FROM events WHERE 'sku-' || user_id = 'sku-8'""",
)
def _filter(spark, sf_dir):
    return nested_events(spark, sf_dir).filter("itemId = 'sku-8'").select("event_id", "quantity")


@query(
    "preview",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10",
)
def _preview(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return preview(rows, ["o_totalprice", "o_orderkey"], 10)


@query(
    "init_upper",
    """SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS name, lower(p_brand) AS brand FROM part""",
)
def _init_upper(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.init_upper(F.col("p_name")).alias("name"), F.lower("p_brand").alias("brand")
    )


@query(
    "before_colon",
    """SELECT page_id, CASE WHEN instr(url, ':') > 1 THEN substr(url, 1, instr(url, ':') - 1) ELSE url END AS scheme,
              CASE WHEN instr(html, ':') > 1 THEN substr(html, 1, instr(html, ':') - 1) ELSE html END AS head
       FROM pages""",
)
def _before_colon(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        text.before_first(F.col("url")).alias("scheme"),
        text.before_first(F.col("html")).alias("head"),
    )


@query(
    "text_tests",
    """SELECT conv_id, turn, trim("text", ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed,
              starts_with("text", 'The') AS starts,
              contains("text", 'data') AS mentions FROM conversations""",
)
def _text_tests(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        text.strip_blanks(F.col("text")).alias("trimmed"),
        F.startswith("text", F.lit("The")).alias("starts"),
        F.contains("text", F.lit("data")).alias("mentions"),
    )


@query("last_token", """SELECT page_id, split_part(rtrim(url, '.'), '.', -1) AS token FROM pages""")
def _last_token(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.last_token(F.col("url")).alias("token"))


@query(
    "extract_digits",
    """SELECT doc_id, array_to_string(regexp_extract_all("text", '[0-9]+'), ',') AS digits FROM documents""",
)
def _digits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(text.digit_groups(F.col("text")), ",").alias("digits")
    )


@query(
    "char_count",
    """SELECT doc_id, length("text") - length(replace("text", 'e', '')) AS marks,
              right("text", 5) AS ending FROM documents""",
)
def _char_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.count_char(F.col("text"), "e").cast("bigint").alias("marks"),
        text.tail(F.col("text"), 5).alias("ending"),
    )
