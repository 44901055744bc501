"""Versioned tables on plain Parquet files.

Layout below a root folder::

    data/<id>/                Parquet files written by one change
    replaced/<id>/            one row per file that a change replaced
    incoming/<id>/            a merge's source, as it was when the merge ran, and the files and keys it met
    history/version=<n>/      one row per finished version

A version is a list of folders, each with the number of its files that later
changes replaced, and a list of the tables that name these.  An overwrite stores all rows anew; an update, a delete or a
merge rewrites only the files that hold a row it changes and shares the others
with the version before, so a small change to a large table costs a scan of the
columns it tests and a copy of the files it hits.  A read is given folders, as
many as changes.  Up to `NAMED_FILES` replaced files are left out by name before they are
opened; more are left out by a join of each row's file with the stored tables, so that neither a plan nor the driver
holds their names.  Schema and row count come from the history.

Files are written first and the history row last, so a write that fails or is
cut off is never visible.  Older versions stay readable.  One writer at a time:
this is not a transaction log, but two writers of one version are noticed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, StringType, StructType

from tarnlake.operators.conform import common_type
from tarnlake.operators.mutate import (
    delete_where,
    diff_counts,
    expression,
    merged_rows,
    same_keys,
    stored_source,
    unmatched_rows,
    update_where,
)
from tarnlake.operators.shape import quoted

# "columns" is the version's schema as JSON; "replaced" counts files, "lists" are the tables that name them as folder/file.
HISTORY_SCHEMA = (
    "committed_at timestamp, operation string, parameters string, row_count bigint, columns string, "
    "folders array<struct<name: string, files: bigint, replaced: bigint>>, lists array<string>, version int"
)
# File names that a plan may hold.
NAMED_FILES = 1000


def write_version(df: DataFrame, root: str, operation: str = "WRITE", parameters: str = "") -> int:
    """Store all rows of a frame as the next version and return its number, counted from 0."""
    spark = df.sparkSession
    latest = _entry(spark, root)
    folders, row_count = _write_folder(df, root)
    return _commit(spark, root, latest, folders, [], row_count, df.schema, operation, parameters)


def update_version(
    spark: SparkSession, root: str, condition: str | Column, assignments: Mapping[str, str | Column]
) -> int:
    """Write the next version with some rows updated."""
    test = expression(condition)
    return _change(
        spark, root, lambda rows: rows.filter(test), lambda rows: update_where(rows, test, assignments),
        "UPDATE", f"{condition}",
    )


def delete_version(spark: SparkSession, root: str, condition: str | Column) -> int:
    """Write the next version without some rows."""
    test = expression(condition)
    return _change(
        spark, root, lambda rows: rows.filter(test), lambda rows: delete_where(rows, test), "DELETE", f"{condition}"
    )


def merge_version(spark: SparkSession, root: str, source: DataFrame, keys: Sequence[str]) -> int:
    """Write the next version with a source merged in, as ``merge_upsert`` does.

    The source is stored first and searched and merged from that copy, as a
    live table may give other rows each time it is read.  One search gives the files to rewrite and the keys that met: it reads
    the target's keys between the source's smallest and largest one, so on a table that is roughly ordered by
    key, most of it is skipped by its file statistics.
    """
    keys, path = list(keys), f"{root}/incoming/{uuid.uuid4().hex}"
    source = stored_source(_schema(_existing(spark, root)), source, keys, f"{path}/source")

    def hit(rows):
        met = _between(rows, source, keys).alias("t").join(source.select(*map(quoted, keys)).alias("s"), same_keys(keys))
        met = met.select("t._file", *[F.col(f"t.{quoted(k)}") for k in keys]).distinct()
        met.write.parquet(f"{path}/met")
        return spark.read.schema(met.schema).parquet(f"{path}/met")

    def change(rows):
        met = spark.read.parquet(f"{path}/met").select(*map(quoted, keys)).distinct()
        return merged_rows(rows, source, unmatched_rows(source, met, keys, f"{path}/fresh"), keys)

    return _change(spark, root, hit, change, "MERGE", ",".join(keys))


def history(spark: SparkSession, root: str) -> DataFrame:
    """One row per version: number, time, operation, parameters, row count, columns, folders."""
    return spark.read.schema(HISTORY_SCHEMA).parquet(f"{root}/history")


def latest_version(spark: SparkSession, root: str) -> int | None:
    """Number of the newest finished version, None when there is none."""
    entry = _entry(spark, root)
    return None if entry is None else entry["version"]


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The rows as of one version."""
    entry = _entry(spark, root, version)
    if entry is None:
        raise ValueError(f"no version {version} in {root}")
    return _read(spark, root, entry)


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the newest version."""
    return _read(spark, root, _existing(spark, root))


def register_latest(spark: SparkSession, root: str, view: str) -> None:
    """A view on the newest version; register again to move it on."""
    read_latest(spark, root).createOrReplaceTempView(view)


def version_diff(spark: SparkSession, root: str, before: int, after: int, keys: Sequence[str]) -> DataFrame:
    """Inserted, updated and deleted row counts between two versions.

    Files that both versions share hold no difference and are not read.  A
    column that only one of them has counts as NULL in the other; both need the
    keys.  Columns whose type changed are compared as the narrowest type that
    holds all values of both, see ``common_type``; without one this raises ``TypeError``.
    """
    found = [_entry(spark, root, v) for v in (before, after)]
    for number, entry in zip((before, after), found):
        if entry is None:
            raise ValueError(f"no version {number} in {root}")
        missing = [k for k in keys if k not in _schema(entry).fieldNames()]
        if missing:
            raise ValueError(f"version {number} in {root} has no column {', '.join(missing)}")
    schemas = [{f.name: f.dataType for f in _schema(entry).fields} for entry in found]
    columns = {}
    for name in [*schemas[0], *(c for c in schemas[1] if c not in schemas[0])]:
        kinds = [schema[name] for schema in schemas if name in schema]
        columns[name] = common_type(kinds[0], kinds[-1])
        if columns[name] is None:
            old, new = (kind.simpleString() for kind in kinds)
            raise TypeError(f"column {name} is {old} in version {before} of {root} and {new} in version {after}: no type holds both")

    def rows(entry, other):
        own = _schema(entry).fieldNames()
        return _unshared(spark, root, entry, other).select(
            *[(F.col(quoted(c)) if c in own else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()]
        )

    return diff_counts(rows(*found), rows(*found[::-1]), keys)


def _change(spark, root, hit, change, operation, parameters):
    """Rewrite the files holding rows that ``hit`` keeps by ``change``, share the others."""
    latest = _existing(spark, root)
    folders = [f["name"] for f in latest["folders"]]
    # The names of the files to replace are stored; only their numbers come back, by folder.
    new_list = uuid.uuid4().hex
    hit(_read(spark, root, latest, named=True)).select(F.col("_file").alias("file")).distinct().write.parquet(
        f"{root}/replaced/{new_list}"
    )
    names = _names(spark, root, [new_list], folders)
    touched = {r["folder"]: r["count"] for r in names.groupBy(_folder().alias("folder")).count().collect()}
    if not touched and operation != "MERGE":
        return _commit(
            spark, root, latest, latest["folders"], latest["lists"], latest["row_count"], _schema(latest), operation, parameters
        )
    old = _only(_scan(spark, root, list(touched), _schema(latest)), names, sum(touched.values()))
    written, row_count = _write_folder(change(old), root)
    kept = [(name, files, replaced + touched.get(name, 0)) for name, files, replaced in latest["folders"]]
    kept = [f for f in kept if f[2] < f[1]]
    lists = [*latest["lists"], *([new_list] if touched else [])] if any(f[2] for f in kept) else []
    row_count += latest["row_count"] - old.count()
    return _commit(spark, root, latest, kept + written, lists, row_count, _schema(latest), operation, parameters)


def _between(rows, source, keys):
    """Rows whose keys lie between the source's bounds; only bounds that carry over exactly are used."""
    plain = [k for k in keys if isinstance(source.schema[k].dataType, (IntegralType, StringType, DateType))]
    if not plain:
        return rows
    bounds = source.agg(*[f(quoted(k)) for k in plain for f in (F.min, F.max)]).first()
    for i, k in enumerate(plain):
        rows = rows.filter(F.col(quoted(k)).between(F.lit(bounds[2 * i]), F.lit(bounds[2 * i + 1])))
    return rows


def _write_folder(df, root):
    """Store a frame in a new folder: its entry, if it has files, and its row count."""
    folder = uuid.uuid4().hex
    df.write.parquet(f"{root}/data/{folder}")
    # Counted from what is stored: a count taken during the write could be
    # wrong after a retried task.  It reads footers, no columns.
    written = _scan(df.sparkSession, root, [folder], df.schema)
    files = len(written.inputFiles())
    return ([(folder, files, 0)], written.count()) if files else ([], 0)


def _schema(entry):
    return StructType.fromJson(json.loads(entry["columns"]))


def _file():
    return F.substring_index("_metadata.file_path", "/", -2)


def _folder():
    return F.substring_index("file", "/", 1)


def _scan(spark, root, folders, schema):
    """The rows of some folders."""
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/data/{name}" for name in folders])


def _names(spark, root, lists, folders):
    """``file`` of all files of some folders that some lists name."""
    if not lists:
        return spark.createDataFrame([], "file string")
    rows = spark.read.schema("file string").parquet(*[f"{root}/replaced/{name}" for name in lists])
    return rows.filter(_folder().isin(folders))


def _only(rows, names, count):
    """The rows of the ``count`` named files."""
    if not count:
        return rows.limit(0)
    if count <= NAMED_FILES:
        # A test on the name alone, which Spark applies to the list of files.
        return rows.filter(_file().isin([r["file"] for r in names.collect()]))
    columns = rows.columns
    return rows.withColumn("_file", _file()).join(names, F.col("_file") == F.col("file"), "left_semi").select(*map(quoted, columns))


def _without(rows, names, count):
    """The rows of all but the ``count`` named files."""
    if not count:
        return rows
    if count <= NAMED_FILES:
        return rows.filter(~_file().isin([r["file"] for r in names.collect()]))
    columns = rows.columns
    return rows.withColumn("_file", _file()).join(names, F.col("_file") == F.col("file"), "left_anti").select(*map(quoted, columns))


def _live(spark, root, folders, lists, schema, named=False):
    """The rows of some folders of a version without their replaced files; with ``_file`` if named."""
    whole = [f["name"] for f in folders if not f["replaced"]]
    partly = [f["name"] for f in folders if f["replaced"]]
    count = sum(f["replaced"] for f in folders)
    names = _names(spark, root, lists, partly)

    def scan(some):
        rows = _scan(spark, root, some, schema)
        return rows.withColumn("_file", _file() if some else F.lit("")) if named else rows

    if count <= NAMED_FILES or not whole:
        return _without(scan(whole + partly), names, count)
    return scan(whole).unionByName(_without(scan(partly), names, count))


def _read(spark, root, entry, named=False):
    return _live(spark, root, entry["folders"], entry["lists"], _schema(entry), named)


def _unshared(spark, root, entry, other):
    """The rows of the files that ``other`` does not have."""
    there = {f["name"]: f for f in other["folders"]}
    own = [f for f in entry["folders"] if f["name"] not in there]
    rows = _live(spark, root, own, entry["lists"], _schema(entry))
    # Of folders in both, the files that were replaced on the way to the other.
    shared = [f for f in entry["folders"] if f["name"] in there and there[f["name"]]["replaced"] > f["replaced"]]
    if not shared:
        return rows
    folders = [f["name"] for f in shared]
    names = _names(spark, root, [name for name in other["lists"] if name not in entry["lists"]], folders)
    count = sum(there[f["name"]]["replaced"] - f["replaced"] for f in shared)
    return rows.unionByName(_only(_scan(spark, root, folders, _schema(entry)), names, count))


def _commit(spark, root, latest, folders, lists, row_count, schema, operation, parameters):
    version = 0 if latest is None else latest["version"] + 1
    columns = json.dumps(schema.jsonValue())
    entry = (None, operation, parameters, row_count, columns, [tuple(f) for f in folders], list(lists), version)
    (
        spark.createDataFrame([entry], HISTORY_SCHEMA)
        .withColumn("committed_at", F.current_timestamp())
        .coalesce(1)
        .write.mode("append")
        .partitionBy("version")
        .parquet(f"{root}/history")
    )
    return version


def _existing(spark, root):
    entry = _entry(spark, root)
    if entry is None:
        raise ValueError(f"no versions in {root}")
    return entry


def _entry(spark, root, version=None):
    """History row of a version, of the newest one without a number; None when there is none."""
    try:
        rows = history(spark, root)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if version is None:
        numbers = [int(name.rsplit("version=", 1)[1].split("/")[0]) for name in rows.inputFiles()]
        if not numbers:
            return None
        version = max(numbers)
    # One folder of the history is read, the rows of other versions are not.
    found = rows.filter(F.col("version") == version).take(2)
    if len(found) > 1:
        raise RuntimeError(f"version {version} in {root} was written by two writers")
    return found[0] if found else None
