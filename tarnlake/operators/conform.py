"""Bring columns to a declared type: JDBC type names or Hive type strings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import ParseException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    ByteType,
    CharType,
    DataType,
    DecimalType,
    DoubleType,
    IntegerType,
    MapType,
    ShortType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
    VarcharType,
)

from tarnlake.operators.shape import quoted

# The Spark type each JDBC type is read as.  Signed numbers;
# unsigned ones are in JDBC_UNSIGNED.  Types not listed have no Spark type.
JDBC_TYPES = {
    "BIGINT": "bigint",
    "BINARY": "binary",
    "BIT": "boolean",
    "BLOB": "binary",
    "BOOLEAN": "boolean",
    "CHAR": "string",
    "CLOB": "string",
    "DATE": "date",
    "DECIMAL": "double",
    "DOUBLE": "double",
    "FLOAT": "float",
    "INTEGER": "int",
    "LONGNVARCHAR": "string",
    "LONGVARBINARY": "binary",
    "LONGVARCHAR": "string",
    "NCHAR": "string",
    "NCLOB": "string",
    "NUMERIC": "double",
    "NVARCHAR": "string",
    "REAL": "double",
    "REF": "string",
    "ROWID": "bigint",
    "SMALLINT": "int",
    "SQLXML": "string",
    "STRUCT": "string",
    "TIME": "timestamp",
    "TIMESTAMP": "timestamp",
    "TINYINT": "int",
    "VARBINARY": "binary",
    "VARCHAR": "string",
}
JDBC_UNSIGNED = {"BIGINT": "decimal(20,0)", "INTEGER": "bigint"}


def jdbc_type(name: str, signed: bool = True) -> str | None:
    """Spark type of a JDBC type name, None when there is none."""
    key = name.upper()
    if not signed and key in JDBC_UNSIGNED:
        return JDBC_UNSIGNED[key]
    return JDBC_TYPES.get(key)


def conform_jdbc(df: DataFrame, declared: Mapping[str, str | tuple[str, bool]]) -> DataFrame:
    """Cast the named columns to what their JDBC type is read as.

    ``declared`` maps a column to a JDBC type name, or to (name, signed).  A
    type without a Spark counterpart gives NULL, and so does a value that does
    not fit.
    """
    out = {}
    for column, spec in declared.items():
        target = jdbc_type(spec) if isinstance(spec, str) else jdbc_type(*spec)
        if target is None:
            out[column] = F.lit(None).cast("string")
        else:
            out[column] = F.col(quoted(column)).try_cast(target)
    return df.withColumns(out)


def widen_jdbc(df: DataFrame) -> DataFrame:
    """Apply the JDBC reading rules to a whole frame by its own types:
    decimals to double, one- and two-byte integers to int, zone-less
    timestamps to timestamps."""
    out = {}
    for field in df.schema.fields:
        dtype = field.dataType
        if isinstance(dtype, DecimalType):
            out[field.name] = F.col(quoted(field.name)).cast(DoubleType())
        elif isinstance(dtype, (ByteType, ShortType)):
            out[field.name] = F.col(quoted(field.name)).cast(IntegerType())
        elif dtype.typeName() == "timestamp_ntz":
            out[field.name] = F.col(quoted(field.name)).cast(TimestampType())
    return df.withColumns(out) if out else df


def conform_hive(df: DataFrame, declared: Mapping[str, str], empty_as_null: bool = True) -> DataFrame:
    """Bring columns to Hive type strings, keeping only the declared columns in their order.

    Nested types over text columns are decoded from JSON, everything else is
    cast; a value that does not fit becomes NULL.  A type string Spark does not
    know is taken as string.
    """
    from tarnlake.operators.nested import decode_nested

    nested: dict[str, DataType] = {}
    casts = {}
    for column, type_string in declared.items():
        dtype = parse_type(type_string)
        current = df.schema[column].dataType
        if isinstance(dtype, (ArrayType, MapType, StructType)) and isinstance(current, StringType):
            nested[column] = dtype
        elif dtype != current:
            casts[column] = F.col(quoted(column)).try_cast(dtype)
    rows = df.select(*[F.col(quoted(c)) for c in declared])
    if casts:
        rows = rows.withColumns(casts)
    return decode_nested(rows, nested, empty_as_null) if nested else rows


def parse_type(type_string: str) -> DataType:
    """A type string (any case, nested or not) as a Spark type; char and varchar
    become string at any depth, an unknown type becomes string."""
    try:
        dtype = StructType.fromDDL(f"c {type_string}")["c"].dataType
    except ParseException:
        return StringType()
    return _plain(dtype)


# How many digits whole numbers take, and how many of a float or double are exact.
WHOLE_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}
EXACT_DIGITS = {"float": 7, "double": 15}


def common_type(a: DataType, b: DataType) -> DataType | None:
    """The narrowest type that holds every value of both unchanged, nested or not; None if there is none.

    Whole numbers widen to wider ones, to a decimal and, while all their digits are exact there, to float and double; decimals to
    decimals with room for both sides of the point; a date to a timestamp without a zone.  Texts, times and numbers have nothing in common.
    """
    if a.simpleString() == b.simpleString():
        return a
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        element = common_type(a.elementType, b.elementType)
        return element and ArrayType(element)
    if isinstance(a, MapType) and isinstance(b, MapType):
        key, value = common_type(a.keyType, b.keyType), common_type(a.valueType, b.valueType)
        return MapType(key, value) if key and value else None
    if isinstance(a, StructType) and isinstance(b, StructType):
        if a.fieldNames() != b.fieldNames():
            return None
        fields = [(f.name, common_type(f.dataType, g.dataType)) for f, g in zip(a.fields, b.fields, strict=True)]
        return StructType([StructField(n, t) for n, t in fields]) if all(t for _, t in fields) else None
    names = {a.simpleString(), b.simpleString()}
    if names == {"date", "timestamp_ntz"}:
        return TimestampNTZType()
    if names <= {"char", "varchar", "string"} or all(isinstance(t, (StringType, CharType, VarcharType)) for t in (a, b)):
        return StringType()
    return _common_number(a, b)


def _common_number(a: DataType, b: DataType) -> DataType | None:
    whole, inexact = {}, {}
    for t in (a, b):
        name = t.simpleString()
        if name in EXACT_DIGITS:
            inexact[name] = t
        elif name in WHOLE_DIGITS:
            whole[name] = (WHOLE_DIGITS[name], 0)
        elif isinstance(t, DecimalType):
            whole[name] = (t.precision - t.scale, t.scale)
        else:
            return None
    if len(inexact) == 2:
        return DoubleType()
    if inexact:
        ((digits, scale),) = whole.values()
        # Not every fraction has a binary form, so decimals with a scale don't fit.
        fits = [name for name in EXACT_DIGITS if digits <= EXACT_DIGITS[name] and not scale]
        fits = [name for name in fits if name in inexact or name == "double"]
        return parse_type(fits[0]) if fits else None
    digits, scale = (max(part) for part in zip(*whole.values()))
    if not any(isinstance(t, DecimalType) for t in (a, b)):
        return a if WHOLE_DIGITS[a.simpleString()] == digits else b
    return DecimalType(digits + scale, scale) if digits + scale <= 38 else None


def _plain(dtype: DataType) -> DataType:
    if isinstance(dtype, (CharType, VarcharType)):
        return StringType()
    if isinstance(dtype, ArrayType):
        return ArrayType(_plain(dtype.elementType), dtype.containsNull)
    if isinstance(dtype, MapType):
        return MapType(_plain(dtype.keyType), _plain(dtype.valueType), dtype.valueContainsNull)
    if isinstance(dtype, StructType):
        return StructType([StructField(f.name, _plain(f.dataType), f.nullable) for f in dtype.fields])
    return dtype
