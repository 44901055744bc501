"""File sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tarnlake.operators.shape import quoted


def save_parquet(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    max_records_per_file: int = 0,
    rebalance: bool = False,
) -> None:
    """Parquet to a path.

    With ``partition_by`` every task writes its own file per partition value:
    no shuffle, and a frequent value is spread over all tasks.  With many
    tasks and values that makes many small files; ``rebalance`` gathers the
    rows of a value first, at the price of a shuffle, into pieces of the
    advisory size, so small values share a task and a frequent one gets many.
    """
    if rebalance:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def append_batches(batches: Iterable[DataFrame], path: str) -> int:
    """Append frames one after the other to a Parquet folder; returns how many.  Done again, they are there twice; see `append_once`."""
    count = 0
    for batch in batches:
        batch.write.mode("append").parquet(path)
        count += 1
    return count


def append_once(df: DataFrame, path: str, batch: str) -> int:
    """Append the rows whose batch was not appended before; returns how many batches are new.

    ``batch`` is the column that names a row's batch; NULL is a batch too.  A batch comes whole, in one frame.  Rows go to a folder of
    their own, and then the batches they make up into a ledger below ``path``.  A run that fails before that leaves nothing that
    `read_appended` would read, and may be repeated; a run that was finished may be repeated as well.
    """
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    known = _ledger(spark, path, df.schema[batch].dataType)
    offered = F.col(f"n.{quoted(batch)}")
    new = df.alias("n").join(known.alias("k"), offered.eqNullSafe(F.col("k.batch")), "left_anti")
    rows = f"{path}/rows/{attempt}"
    new.write.parquet(rows)
    stored = spark.read.schema(df.schema).parquet(rows)
    batches = stored.groupBy(F.col(quoted(batch)).alias("batch")).agg(F.count(F.lit(1)).alias("rows"))
    batches = batches.withColumn("attempt", F.lit(attempt))
    batches.write.mode("append").parquet(f"{path}/ledger")
    return _ledger(spark, path, df.schema[batch].dataType).filter(F.col("attempt") == attempt).count()


def read_appended(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all batches that `append_once` has finished."""
    found = spark.read.schema("attempt string").parquet(f"{path}/ledger").distinct().collect()  # as many as appends
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/rows/{row[0]}" for row in found])


def _ledger(spark, path, batch_type) -> DataFrame:
    """``batch``, ``rows`` and ``attempt`` of all finished batches."""
    schema = StructType([StructField("batch", batch_type), StructField("rows", LongType()), StructField("attempt", StringType())])
    try:
        return spark.read.schema(schema).parquet(f"{path}/ledger")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def save_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; NULL fields are written out, times to the microsecond."""
    plain = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    options = {"ignoreNullFields": False, "timestampFormat": plain + "XXX", "timestampNTZFormat": plain}
    df.write.mode(mode).options(**options).json(path)


def save_delimited(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    delimiter: str = "|",
    quote: str = '"',
    escape: str = "\\",
    header: bool = True,
    null_value: str = "",
) -> None:
    """Delimited text with quoting; blanks around texts are kept.

    With the usual ``null_value`` an empty text reads back as NULL; give another
    mark, here and in the scan, to tell them apart.
    """
    df.write.mode(mode).options(
        sep=delimiter,
        quote=quote,
        escape=escape,
        header=header,
        nullValue=null_value,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)


def save_text(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Text lines from the one column that is not a partition column."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.text(path)
