"""Column listings and column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, NumericType, ShortType, StringType

from tarnlake.operators.shape import quoted


def table_comments(tables: DataFrame, params: DataFrame) -> DataFrame:
    """Distinct (table, comment) pairs of the listed tables; a parameter other
    than the comment counts as ''.

    The pairs are made distinct before the join, so a table with very many
    parameters is one or two rows by then.
    """
    comment = F.when(F.col("PARAM_KEY") == "comment", F.col("PARAM_VALUE")).otherwise("")
    pairs = params.select("TBL_ID", comment.alias("TBL_COMMENT")).distinct()
    return pairs.join(tables.select("TBL_ID"), "TBL_ID", "left_semi")


def catalog_columns(
    databases: DataFrame,
    tables: DataFrame,
    storage: DataFrame,
    columns: DataFrame,
    params: DataFrame,
    table: str | None = None,
) -> DataFrame:
    """Columns of the tables in a metastore: ``db_table``, ``column_name``, ``column_type``.

    The five inputs are the metastore's own tables (databases, tables, storage
    descriptors, columns, table parameters).  As in the metastore query this
    replaces, a table without parameters is not listed, and one with several
    distinct comments is listed once per comment.  ``table`` (``db.table``)
    keeps one table.
    """
    if table is not None:
        # Told to the sources in their own columns; the name may hold several dots.
        dots = [i for i, char in enumerate(table) if char == "."]
        databases = databases.filter(F.col("NAME").isin([table[:i] for i in dots]))
        tables = tables.filter(F.col("TBL_NAME").isin([table[i + 1 :] for i in dots]))
    per_table = (
        databases.join(tables, "DB_ID")
        .join(storage, "SD_ID")
        .join(table_comments(tables, params), "TBL_ID")
        .select(F.concat("NAME", F.lit("."), "TBL_NAME").alias("db_table"), "CD_ID")
    )
    # The columns, by far the largest input, are joined once and last.
    listing = columns.join(per_table, "CD_ID").select(
        "db_table", F.col("COLUMN_NAME").alias("column_name"), F.col("TYPE_NAME").alias("column_type")
    )
    return listing if table is None else listing.filter(F.col("db_table") == table)


def column_facts(df: DataFrame) -> DataFrame:
    """Declared facts per column: position, name, type, size, scale, signed, nullable.

    Only the schema is used; over a JDBC scan that is a zero-row request.
    Size is digits for decimals and the length for char and varchar.
    """
    rows = []
    for position, field in enumerate(df.schema.fields, start=1):
        dtype = field.dataType
        size = getattr(dtype, "precision", None) or getattr(dtype, "length", None)
        rows.append(
            (
                position,
                field.name,
                dtype.simpleString(),
                size,
                getattr(dtype, "scale", None),
                isinstance(dtype, NumericType),
                field.nullable,
            )
        )
    return df.sparkSession.createDataFrame(
        rows,
        "position int, column_name string, column_type string, size int, scale int, signed boolean, nullable boolean",
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Facts per column, from one pass over the data, in the columns' order.

    Position, name and type; rows and NULLs (whether it is nullable in fact);
    longest text (its size in fact); smallest and largest value as text, for
    text and integer columns only.
    """
    measures, entries = [], []
    for i, field in enumerate(df.schema.fields):
        column = F.col(quoted(field.name))
        is_text = isinstance(field.dataType, StringType)
        ordered = is_text or isinstance(field.dataType, (ByteType, ShortType, IntegerType, LongType))
        measures.append(F.count(column).alias(f"_n{i}"))
        if is_text:
            measures.append(F.max(F.length(column)).alias(f"_w{i}"))
        if ordered:
            measures += [F.min(column).alias(f"_lo{i}"), F.max(column).alias(f"_hi{i}")]
        entries.append(
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("column_type"),
                F.col("_rows").alias("row_count"),
                (F.col("_rows") - F.col(f"_n{i}")).alias("null_count"),
                (F.col(f"_w{i}") if is_text else F.lit(None)).cast("bigint").alias("longest_text"),
                (F.col(f"_lo{i}") if ordered else F.lit(None)).cast("string").alias("min_value"),
                (F.col(f"_hi{i}") if ordered else F.lit(None)).cast("string").alias("max_value"),
            )
        )
    one_row = df.agg(F.count(F.lit(1)).alias("_rows"), *measures)
    return one_row.select(F.inline(F.array(*entries)))
