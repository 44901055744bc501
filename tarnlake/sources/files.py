"""File scans: Parquet, JSON lines, delimited text, plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from tarnlake.operators.shape import quoted, require_new_names
from tarnlake.sources.inference import infer_json_type

# Different keys of an object beyond which they count as data.
MAX_FIELDS = 1000


def scan_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet files.  Filters and column choices made on the result reach the scan."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def scan_json_lines(
    spark: SparkSession, path: str, schema: StructType | str | None = None, max_fields: int | None = None
) -> DataFrame:
    """JSON lines.

    Without ``schema`` the types are inferred from every line, which reads the
    files twice; give a schema for large inputs.  With ``max_fields`` they are inferred as in
    `scan_json_texts`, so that objects whose keys are data become maps.
    """
    if schema is None and max_fields is not None:
        return scan_json_texts(spark.read.text(path), "value", max_fields=max_fields)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def scan_json_texts(
    df: DataFrame, column: str, schema: StructType | str | None = None, max_fields: int = MAX_FIELDS
) -> DataFrame:
    """JSON objects held as texts in a column: their fields become columns, other columns stay.

    Without ``schema`` the fields and types are found in all texts, by one
    aggregate for each level of nesting, with the fields in alphabetical order as in a JSON file scan.  Objects with more than about
    ``max_fields`` different keys become maps; if the texts themselves are such objects, the column becomes a map.
    A text that is not JSON gives NULL fields.
    """
    if schema is None:
        schema = infer_json_type(df, column, max_fields)
    elif isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if isinstance(schema, MapType):
        return df.withColumn(column, F.from_json(F.col(quoted(column)), schema))
    if not isinstance(schema, StructType):
        raise ValueError(f"{column} does not hold JSON objects")
    kept = [F.col(quoted(c)) for c in df.columns if c != column]
    require_new_names([c for c in df.columns if c != column], schema.fieldNames())
    return df.select(*kept, F.from_json(F.col(quoted(column)), schema).alias("_json")).select(
        *kept, *[F.col("_json")[f].alias(f) for f in schema.fieldNames()]
    )


def scan_delimited(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    delimiter: str = "|",
    quote: str = '"',
    escape: str = "\\",
    header: bool = True,
    multi_line: bool = False,
    null_value: str = "",
) -> DataFrame:
    """Delimited text with quoting.

    Without ``schema`` the types are inferred, at the price of a second read.
    ``multi_line`` allows line breaks inside quotes; a file, however large, is then read by one
    task, so leave it off for large files that do not need it.
    """
    reader = spark.read.options(
        sep=delimiter, quote=quote, escape=escape, header=header, multiLine=multi_line, nullValue=null_value
    )
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return reader.csv(path)


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """Text lines in column ``value``; ``key=value`` folders below ``path`` become columns."""
    return spark.read.text(path)
