"""Queries over nested decoding and type conformance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.functions.text import TO_THE_END
from tarnlake.functions.time import epoch_millis
from tarnlake.operators.conform import conform_hive, conform_jdbc, widen_jdbc
from tarnlake.operators.nested import decode_nested, decode_rows, encode_nested
from tarnlake.plans.fixtures import table
from tarnlake.plans.registry import query


@query(
    "decode_struct",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def _struct(spark, sf_dir):
    rows = decode_nested(table(spark, sf_dir, "events"), {"props": "struct<k:bigint>"})
    return rows.select("event_id", "props.k")


def _measures(spark, sf_dir):
    """Line items with two measures as JSON array text, built row by row."""
    lines = table(spark, sf_dir, "lineitem")

    def measure(name, column):
        flags = F.array("l_returnflag", "l_linestatus")
        return F.struct(F.lit(name).alias("name"), F.col(column).alias("amount"), flags.alias("flags"))

    array = F.array(measure("quantity", "l_quantity"), measure("discount", "l_discount"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", F.to_json(array).alias("measures"))


@query(
    "decode_array",
    """
SELECT l_orderkey, l_linenumber, l_partkey, 'quantity' AS name, l_quantity AS amount, l_linestatus AS flag FROM lineitem
UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, 'discount', l_discount, l_linestatus FROM lineitem
""",
)
def _array(spark, sf_dir):
    rows = decode_rows(
        _measures(spark, sf_dir), "measures", "array<struct<name:string,amount:double,flags:array<string>>>"
    )
    return rows.withColumn("flag", F.col("flags")[1]).drop("flags")


@query(
    "decode_array_sizes",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN NULL ELSE len(string_split(p_name, ' ')) END AS some_words,
              len(string_split(p_name, ' ')) AS all_words, array_to_string(string_split(p_name, ' '), '|') AS joined FROM part""",
)
def _array_sizes(spark, sf_dir):
    """Sizes and elements of an array of texts, and of one that is empty for large parts, which decodes to NULL."""
    words = F.to_json(F.split("p_name", " "))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", words.alias("words"), F.when(F.col("p_size") > 25, "[ ]").otherwise(words).alias("some")
    )
    out = decode_nested(rows, {"words": "array<string>", "some": "array<varchar(30)>"})
    return out.select(
        "p_partkey",
        F.when(F.col("some").isNotNull(), F.size("some")).cast("bigint").alias("some_words"),
        F.size("words").cast("bigint").alias("all_words"),
        F.array_join("words", "|").alias("joined"),
    )


@query(
    "decode_leaves",
    """
SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS TINYINT) AS small, CAST(l_partkey AS BIGINT) AS big,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents, CAST(CAST(l_tax AS FLOAT) AS DOUBLE) AS rate,
       l_quantity > 25 AS large, hex(encode(l_returnflag)) AS flag_hex,
       epoch_us(l_shipdate) // 1000 AS shipped, CASE WHEN l_quantity > 1 THEN l_linenumber ELSE -1 END AS mixed,
       l_partkey || ',NULL,' || l_suppkey AS listed
FROM lineitem
""",
)
def _leaves(spark, sf_dir):
    text = F.to_json(
        F.struct(
            F.col("l_linenumber").alias("small"),
            F.col("l_partkey").alias("big"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
            F.col("l_tax").alias("rate"),
            (F.col("l_quantity") > 25).alias("large"),
            F.base64(F.encode("l_returnflag", "UTF-8")).alias("flag"),
            F.concat(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0000")).alias("shipped"),
        )
    )
    # One more leaf, not a number in some lines, where it becomes NULL.
    mixed = F.when(F.col("l_quantity") > 1, F.col("l_linenumber").cast("string")).otherwise('"none"')
    # And an array whose second element is not a number.
    listed = F.concat(F.lit('"listed":['), "l_partkey", F.lit(',"x",'), "l_suppkey", F.lit("],"))
    text = F.concat(F.lit('{"mixed":'), mixed, F.lit(","), listed, F.substring(text, 2, TO_THE_END))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("payload"))
    declared = (
        "struct<small:tinyint,big:bigint,price:decimal(18,2),rate:float,large:boolean,"
        "flag:binary,shipped:timestamp,mixed:int,listed:array<bigint>>"
    )
    rows = decode_nested(lines, {"payload": declared})
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "payload.small",
        "payload.big",
        (F.col("payload.price") * 100).cast("bigint").alias("cents"),
        F.col("payload.rate").cast("double").alias("rate"),
        "payload.large",
        F.hex("payload.flag").alias("flag_hex"),
        F.unix_millis("payload.shipped").alias("shipped"),
        F.coalesce("payload.mixed", F.lit(-1)).alias("mixed"),
        F.array_join("payload.listed", ",", "NULL").alias("listed"),
    )


@query(
    "decode_wrong_elements",
    """
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS quantity,
       CASE WHEN l_linenumber > 3 THEN 'quantity' ELSE 'quantity,line' END AS known,
       CAST(CASE WHEN l_linenumber > 3 THEN NULL ELSE l_linenumber END AS BIGINT) AS line,
       CAST(CASE WHEN l_linenumber > 3 THEN 3 ELSE 2 END AS BIGINT) AS n_parts, l_partkey AS first_part, l_suppkey AS last_part,
       l_returnflag AS flag, CASE WHEN l_linenumber % 2 = 0 THEN '1,NULL' ELSE '1,2' END AS grid, l_partkey AS deep
FROM lineitem
""",
)
def _wrong_elements(spark, sf_dir):
    """Maps, arrays of structs, of arrays and of maps, with elements of another kind in some lines."""
    late, even = F.col("l_linenumber") > 3, F.col("l_linenumber") % 2 == 0
    text = F.concat(
        F.lit('{"amounts":{"quantity":'), F.col("l_quantity").cast("bigint"), F.lit(',"line":'),
        F.when(late, '"late"').otherwise(F.col("l_linenumber").cast("string")),
        F.lit('},"parts":[{"part":'), "l_partkey", F.lit(',"flags":["'), "l_returnflag", F.lit('"]},'),
        F.when(late, "5,").otherwise(""), F.lit('{"part":'), "l_suppkey", F.lit('}],"grid":[[1,'),
        F.when(even, '"x"').otherwise("2"), F.lit("]"), F.when(even, ",7").otherwise(""),
        F.lit('],"deep":[{"k":[{"p":'), "l_partkey", F.lit("}"), F.when(late, ',"z"').otherwise(""), F.lit("]}]}"),
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("payload"))
    declared = (
        "struct<amounts:map<string,bigint>,parts:array<struct<part:bigint,flags:array<string>>>,"
        "grid:array<array<bigint>>,deep:array<map<string,array<struct<p:bigint>>>>>"
    )
    rows = decode_nested(lines, {"payload": declared}).select("l_orderkey", "l_linenumber", "payload.*")
    known = F.map_filter("amounts", lambda _, v: v.isNotNull())
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        F.col("amounts")["quantity"].alias("quantity"),
        F.array_join(F.map_keys(known), ",").alias("known"),
        F.col("amounts")["line"].alias("line"),
        F.size("parts").cast("bigint").alias("n_parts"),
        F.col("parts")[0]["part"].alias("first_part"),
        F.element_at("parts", -1)["part"].alias("last_part"),
        F.col("parts")[0]["flags"][0].alias("flag"),
        F.array_join(F.col("grid")[0], ",", "NULL").alias("grid"),
        F.col("deep")[0]["k"][0]["p"].alias("deep"),
    )


@query(
    "encode_nested",
    """SELECT event_id, CAST(json_object('k', CAST(json_extract(props, '$.k') AS BIGINT)) AS VARCHAR) AS props FROM events""",
)
def _encode(spark, sf_dir):
    """Decode, then back to text."""
    rows = decode_nested(table(spark, sf_dir, "events").select("event_id", "props"), {"props": "struct<k:bigint>"})
    return encode_nested(rows, ["props"])


@query(
    "conform_jdbc",
    """SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS price,
              CAST(l_partkey AS BIGINT) AS part, l_returnflag AS flag, CAST(NULL AS VARCHAR) AS other
       FROM lineitem""",
)
def _jdbc(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").cast("smallint").alias("l_linenumber"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("l_partkey").cast("string").alias("part"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("other"),
    )
    return conform_jdbc(
        rows,
        {
            "l_linenumber": "SMALLINT",
            "price": "DECIMAL",
            "part": ("INTEGER", False),
            "flag": "VARCHAR",
            "other": "DISTINCT",
        },
    )


@query(
    "widen_jdbc",
    """SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price, CAST(o_custkey % 100 AS INTEGER) AS bucket
       FROM orders""",
)
def _widen(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        (F.col("o_custkey") % 100).cast("tinyint").alias("bucket"),
    )
    return widen_jdbc(rows)


@query(
    "conform_hive",
    """SELECT event_id, CAST(user_id AS INTEGER) AS user_id, CAST(round(value, 2) AS DECIMAL(10,2))::DOUBLE AS value,
              event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, epoch_us(ts) // 1000 AS ts
       FROM events""",
)
def _hive(spark, sf_dir):
    rows = conform_hive(
        table(spark, sf_dir, "events"),
        {
            "event_id": "bigint",
            "user_id": "INT",
            "value": "decimal(10,2)",
            "event_type": "varchar(20)",
            "props": "struct<k:int>",
            "ts": "timestamp_ntz",
        },
    )
    return rows.select(
        "event_id",
        "user_id",
        F.col("value").cast("double").alias("value"),
        "event_type",
        "props.k",
        epoch_millis(F.col("ts")).alias("ts"),
    )
