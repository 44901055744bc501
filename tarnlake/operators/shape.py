"""Column and row shaping.  Everything here is a narrow projection or filter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def quoted(name: str) -> str:
    """A column name taken literally, dots included."""
    return "`" + name.replace("`", "``") + "`"


def require_new_names(columns: Sequence[str], fields: Sequence[str]) -> None:
    """Raise if a field that becomes a column is called like one that stays."""
    clash = {n.lower() for n in fields} & {n.lower() for n in columns}
    if clash:
        raise ValueError(f"fields already exist as columns: {sorted(clash)}")


def flatten_struct(df: DataFrame, column: str) -> DataFrame:
    """Replace a struct column by its fields, at the same place and with their types."""
    fields = _struct(df, column).fieldNames()
    others = [c for c in df.columns if c != column]
    require_new_names(others, fields)
    out: list[Column] = []
    for name in df.columns:
        if name == column:
            out += [F.col(quoted(column))[f].alias(f) for f in fields]
        else:
            out.append(F.col(quoted(name)))
    return df.select(*out)


def nest_columns(df: DataFrame, columns: Sequence[str], into: str) -> DataFrame:
    """The reverse of ``flatten_struct``: pack columns into one struct column at the end."""
    kept = [F.col(quoted(c)) for c in df.columns if c not in set(columns)]
    return df.select(*kept, F.struct(*[F.col(quoted(c)) for c in columns]).alias(into))


def normalize_names(df: DataFrame, lowercase: bool = True) -> DataFrame:
    """Drop a ``table.`` prefix from column names and lower-case them."""
    names = [c.rstrip(".").rsplit(".", 1)[-1] or c for c in df.columns]
    if lowercase:
        names = [n.lower() for n in names]
    if len(set(names)) != len(names):
        raise ValueError(f"column names are no longer unique: {names}")
    return df if names == df.columns else df.toDF(*names)


def map_count(df: DataFrame) -> DataFrame:
    """Map every row to a constant, then count."""
    return df.select(F.lit(1).alias("one")).agg(F.count("one").alias("rows"))


def preview(df: DataFrame, order: Sequence[str], rows: int) -> DataFrame:
    """First rows in a stated order.  Each task keeps only its own first rows."""
    return df.orderBy(*order).limit(rows)


def project_json(
    df: DataFrame,
    fields: Mapping[str, str | None],
    init_upper: Sequence[str] = (),
    into: str = "json",
) -> DataFrame:
    """One JSON text per row from the chosen columns.

    ``fields`` maps a column to its key (``None`` keeps the name); columns not
    named are left out.  ``init_upper`` names text columns whose first letter
    is upper-cased before.
    """
    from tarnlake.functions import text

    parts = []
    for source, key in fields.items():
        value = F.col(source)
        if source in init_upper:
            value = text.init_upper(value)
        parts.append(value.alias(key or source))
    return df.withColumn(into, F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}))


def _struct(df: DataFrame, column: str) -> StructType:
    dtype = df.schema[column].dataType
    if not isinstance(dtype, StructType):
        raise TypeError(f"{column} is {dtype.simpleString()}, not a struct")
    return dtype
