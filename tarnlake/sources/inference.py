"""The type of JSON texts, found level by level, with objects of very many keys as maps.

A level holds the values under each path.  One aggregate says of each path what kinds of values it has, the type that holds its plain ones, and about
how many keys its objects have together.  An object of few keys is a struct, each key a path of the next level; one of more keys, such
as ids, is a map, all its values one path.  So what comes to the driver, and the schema, are bounded by the texts' depth and ``max_fields``, not by the data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, DoubleType, MapType, NullType, StringType, StructField, StructType, VariantType

# Steps of a path: into an array, into a map's values, and to a key.
ELEMENT, VALUE, KEY = "[]", "{}", "."


def infer_json_type(df: DataFrame, column: str, max_fields: int) -> DataType:
    """The type of the JSON texts in a column: fractions as double, unknown or mixed as string, fields in alphabetical order.

    A text that is not JSON counts as NULL.  The texts are read once for each level of nesting.
    """
    values = df.select(F.array().cast("array<string>").alias("path"), F.try_parse_json(column).alias("v"))
    found: dict[tuple[str, ...], dict] = {}
    while True:
        level, values = _next_level(values, max_fields)
        found.update(level)
        if not any(row["objects"] or row["arrays"] for row in level.values()):
            return _type_of(found, ())


def _next_level(values: DataFrame, max_fields: int) -> tuple[dict, DataFrame]:
    """What is known of each path, and the values one step further."""
    values = values.where("v is not null")
    spark = values.sparkSession
    # A value that is plain, or empty, keeps one row without key and element.
    inside = values.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()))
    inside = inside.select("path", "v", "key", F.col("value").alias("inner"))
    # The type of a whole value is asked only where nothing is inside it.
    inside = inside.withColumn("shown", F.when(F.col("inner").isNull(), F.schema_of_variant("v")))
    is_object = F.col("key").isNotNull() | F.coalesce(F.col("shown").startswith("OBJECT<"), F.lit(False))
    is_array = F.col("key").isNull() & (F.col("inner").isNotNull() | F.coalesce(F.col("shown").startswith("ARRAY<"), F.lit(False)))
    plain = F.when(~is_object & ~is_array & ~F.is_variant_null("v"), F.col("v"))
    kinds = inside.groupBy("path").agg(
        F.count_if(is_object).alias("objects"),
        F.count_if(is_array).alias("arrays"),
        F.count(plain).alias("plain"),
        F.schema_of_variant_agg(plain).alias("type"),
        F.approx_count_distinct("key", 0.01).alias("keys"),
    )
    level = {tuple(row["path"]): row.asDict() | {"map": row["keys"] > max_fields} for row in kinds.collect()}
    objects = [path for path, row in level.items() if row["objects"]]
    maps = [path for path in objects if level[path]["map"]]
    into_map = F.lit(False)
    for path in maps:
        into_map = into_map | (F.col("path") == F.array(*map(F.lit, path)).cast("array<string>"))
    step = F.when(F.col("key").isNull(), F.lit(ELEMENT)).when(into_map, F.lit(VALUE)).otherwise(F.concat(F.lit(KEY), "key"))
    inside = inside.where("inner is not null")
    return level, inside.select(F.concat("path", F.array(step)).alias("path"), F.col("inner").alias("v"))


def _type_of(found: dict, path: tuple[str, ...]) -> DataType:
    row = found.get(path)
    kinds = [k for k in ("objects", "arrays", "plain") if row and row[k]]
    if len(kinds) != 1:
        return StringType()  # only NULL, or a mixture
    if kinds == ["plain"]:
        return plain_type(StructType.fromDDL(re.sub(r"\bOBJECT<", "STRUCT<", f"c {row['type']}"))["c"].dataType)
    if kinds == ["arrays"]:
        return ArrayType(_type_of(found, (*path, ELEMENT)))
    if row["map"]:
        return MapType(StringType(), _type_of(found, (*path, VALUE)))
    keys = sorted(p[-1] for p in found if p and p[:-1] == path and p[-1].startswith(KEY))
    return StructType([StructField(k[len(KEY) :], _type_of(found, (*path, k))) for k in keys])


def plain_type(dtype: DataType) -> DataType:
    """The type a JSON file scan would infer."""
    if isinstance(dtype, DecimalType) and dtype.scale > 0:
        return DoubleType()
    return StringType() if isinstance(dtype, (NullType, VariantType)) else dtype
