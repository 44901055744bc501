"""Copy data sets between file systems and formats."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tarnlake.operators.shape import quoted


def copy_dataset(
    spark: SparkSession,
    source: str,
    target: str,
    source_format: str = "parquet",
    target_format: str = "parquet",
    source_options: Mapping[str, str] | None = None,
    target_options: Mapping[str, str] | None = None,
    partition_by: Sequence[str] = (),
    schema: StructType | str | None = None,
    verify: bool = False,
) -> DataFrame:
    """Read ``source``, write ``target``, return ``target`` read back.

    Both are full URIs, so two file systems meet in one job without changing
    the default one; access settings per bucket belong to the session.  Tasks
    copy in parallel and nothing is shuffled.  Give ``schema`` for text formats
    to save the pass that infers it.  Without it columns that the source's
    folders name are texts, so that values such as ``007`` are kept.

    With ``verify`` both sides are read once more, for a checksum of all rows that doesn't
    depend on their order, and a difference raises ``ValueError``.
    """
    reader = spark.read.format(source_format).options(**(source_options or {}))
    with _folder_values_as_text(spark):
        rows = (reader if schema is None else reader.schema(schema)).load(source)
    writer = rows.write.format(target_format).options(**(target_options or {})).mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(target)
    # The source's schema: types of partition columns would be guessed from folder names.
    copied = spark.read.format(target_format).options(**(target_options or {})).schema(rows.schema).load(target)
    copied = copied.select(*[F.col(quoted(c)) for c in rows.columns])
    if verify:
        there, here = (tuple(checksum(side).first()) for side in (rows, copied))
        if there != here:
            raise ValueError(f"the copy {target} differs from {source}: rows and checksum are {here}, not {there}")
    return copied


def checksum(df: DataFrame) -> DataFrame:
    """``rows`` and ``checksum``, which frames with the same rows share in whatever order and however often each is there.

    The sum of a hash of each row, as a decimal, so it is put together from partial sums, and repeated rows don't cancel.  NULL
    counts as a value of its own, at any depth.
    """
    parts = []
    for field in df.schema.fields:
        column = F.col(quoted(field.name))
        nested = isinstance(field.dataType, (StructType, ArrayType, MapType))
        # A hash passes over NULL, so NULLs must be told apart: by a mark beside a column, in a nested one by its text.
        parts += [F.to_json(F.struct(column), {"ignoreNullFields": "false"})] if nested else [column, column.isNull()]
    hashed = F.xxhash64(*parts) if parts else F.lit(0)
    total = F.coalesce(F.sum(hashed.cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))
    return df.agg(F.count(F.lit(1)).alias("rows"), total.alias("checksum"))


@contextmanager
def _folder_values_as_text(spark: SparkSession) -> Iterator[None]:
    """Types of partition columns aren't guessed meanwhile."""
    setting = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        spark.conf.set(setting, before)
