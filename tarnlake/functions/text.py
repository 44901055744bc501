"""Scalar text expressions.  Each takes and returns a column; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TO_THE_END = 2**31 - 1


def init_upper(text: Column) -> Column:
    """First letter upper-cased, the rest unchanged (``initcap`` would change every word)."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, TO_THE_END))


def strip_blanks(text: Column) -> Column:
    """Without blanks, tabs, line breaks and other control characters at both ends."""
    return F.btrim(text, F.lit("".join(map(chr, range(1, 33)))))


def before_first(text: Column, mark: str = ":") -> Column:
    """Text before the first ``mark``; unchanged when there is none or it comes first."""
    return F.when(F.instr(text, mark) > 1, F.substring_index(text, mark, 1)).otherwise(text)


def last_token(text: Column, mark: str = ".") -> Column:
    """Last part of a text split at ``mark``; marks at the end are not followed by a part."""
    return F.substring_index(F.rtrim(text, F.lit(mark)), mark, -1)


def digit_groups(text: Column) -> Column:
    """All runs of digits, as an array of texts."""
    return F.regexp_extract_all(text, F.lit(r"(\d+)"), 1)


def count_char(text: Column, char: str) -> Column:
    """How often one character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def tail(text: Column, count: int) -> Column:
    """Last ``count`` characters."""
    return F.right(text, F.lit(count))


def iso_timestamp(text: Column) -> Column:
    """ISO text with ``Z``, ``+09:00`` or ``+0900`` as a timestamp; NULL when it does not parse."""
    return text.try_cast("timestamp")


def row_text(*columns: str, separator: str = ",") -> Column:
    """Columns of a row as one text; NULL values are written as ``null``."""
    return F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
