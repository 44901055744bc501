"""Row changes as frame-to-frame operators: update, delete, merge, diff."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnlake.operators.shape import quoted
from tarnlake.session import work_folder


def update_where(df: DataFrame, condition: str | Column, assignments: Mapping[str, str | Column]) -> DataFrame:
    """Set columns in the rows where the condition is true.

    All expressions see the old values.  A NULL condition leaves the row
    alone.  New values are cast to the column's type.  ``a.b`` sets a field of
    a struct column.
    """
    test = expression(condition)
    by_column: dict[str, Column] = {}
    for target, value in assignments.items():
        column, _, field = target.partition(".") if target not in df.columns else (target, "", "")
        if column not in df.columns:
            raise ValueError(f"no column {target!r}")
        new = expression(value)
        if field:
            base = by_column.get(column, F.col(quoted(column)))
            by_column[column] = base.withField(field, new.cast(_field_type(df, column, field)))
        else:
            by_column[column] = new.cast(df.schema[column].dataType)
    out = []
    for name in df.columns:
        old = F.col(quoted(name))
        out.append(F.when(test, by_column[name]).otherwise(old).alias(name) if name in by_column else old)
    return df.select(*out)


def delete_where(df: DataFrame, condition: str | Column) -> DataFrame:
    """Drop the rows where the condition is true; rows where it is NULL stay."""
    return df.filter(~F.coalesce(expression(condition), F.lit(False)))


def merge_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Update matching rows from ``source``, insert the source rows without a match.

    Every target row with a matching key takes all source values, also when
    several target rows share the key.  NULL keys never match.  Two source
    rows for one key raise an error.

    The source is read once: it is stored in the work folder, checked for
    repeated keys, and its rows without a match are stored too, found by one
    pass over the target's keys alone.  The result then reads the target once.  It is
    the outer side of a left join: not shuffled at all while the source is small
    enough to broadcast, and otherwise Spark can split a hot target key at run
    time, which it cannot do in a full outer join.
    """
    keys, folder = list(keys), work_folder(target.sparkSession)
    source = stored_source(target.schema, source, keys, f"{folder}/source")
    # Distinct first, so a hot key is one row per task before its shuffle; Spark
    # moves the semi join below that when the source can be broadcast.
    present = target.select(*map(quoted, keys)).distinct()
    matched = present.alias("t").join(source.alias("s"), same_keys(keys), "left_semi")
    return merged_rows(target, source, unmatched_rows(source, matched, keys, f"{folder}/fresh"), keys)


def stored_source(schema: StructType, source: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """A merge's source, cast to the target's schema, as stored under ``path``; a key with several rows raises."""
    if set(schema.fieldNames()) != set(source.columns):
        raise ValueError("target and source need the same columns")
    rows = source.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])
    rows = _stored(rows, path)
    has_key = reduce(and_, [F.col(quoted(k)).isNotNull() for k in keys])
    repeated = rows.filter(has_key).groupBy(*map(quoted, keys)).count().filter("count > 1").first()
    if repeated is not None:
        raise ValueError(f"merge source has several rows for one key: {tuple(repeated)[:-1]}")
    return rows


def unmatched_rows(source: DataFrame, matched: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """The source rows whose key is not among ``matched``, and those with a NULL in it, as stored under ``path``."""
    return _stored(source.alias("t").join(matched.alias("s"), same_keys(keys), "left_anti"), path)


def merged_rows(target: DataFrame, source: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target's rows, with a source's values where the keys are equal, and the ``fresh`` rows."""
    found = F.col(f"s.{quoted(keys[0])}").isNotNull()
    updated = (
        target.alias("t")
        .join(source.alias("s"), same_keys(keys), "left")
        .select(
            *[
                F.col(f"t.{quoted(c)}")
                if c in keys
                else F.when(found, F.col(f"s.{quoted(c)}")).otherwise(F.col(f"t.{quoted(c)}")).alias(c)
                for c in target.columns
            ]
        )
    )
    return updated.unionByName(fresh)


def _stored(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def diff_counts(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows were inserted, updated and deleted between two frames, by key.

    Equal rows cancel first, spread by the whole row, so a key with very many
    rows does not meet in one task; what is left is counted per key.  With
    unique keys this is the usual key-by-key comparison; with repeated keys
    a removed and an added row of one key count as one update.  NULL equals
    NULL.
    """
    columns = old.columns
    if set(columns) != set(new.columns):
        raise ValueError("both frames need the same columns")
    both = old.withColumn("_side", F.lit(-1)).unionByName(new.withColumn("_side", F.lit(1)))
    changed = (
        both.groupBy(*[F.col(quoted(c)) for c in columns])
        .agg(F.sum("_side").alias("_net"))
        .filter("_net <> 0")
    )
    per_key = changed.groupBy(*[F.col(quoted(k)) for k in keys]).agg(
        F.sum(F.greatest("_net", F.lit(0))).alias("_plus"),
        F.sum(F.greatest(-F.col("_net"), F.lit(0))).alias("_minus"),
    )
    both_ways = F.least("_plus", "_minus")
    totals = per_key.agg(
        F.sum(F.col("_plus") - both_ways).alias("inserted"),
        F.sum(both_ways).alias("updated"),
        F.sum(F.col("_minus") - both_ways).alias("deleted"),
    )
    return totals.select(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in totals.columns])


def same_keys(keys: Sequence[str]) -> Column:
    """True where the frames ``t`` and ``s`` have the same, known keys."""
    return reduce(and_, [F.col(f"t.{quoted(k)}") == F.col(f"s.{quoted(k)}") for k in keys])


def expression(value: str | Column) -> Column:
    """SQL text or a column, as a column."""
    return F.expr(value) if isinstance(value, str) else value


def _field_type(df, column, field):
    dtype = df.schema[column].dataType
    for part in field.split("."):
        dtype = dtype[part].dataType
    return dtype
