"""Catalog definitions, listings, profiles, and file sinks."""

import glob
import uuid

import pytest
from pyspark.sql import functions as F

from tarnlake.catalog.columns import catalog_columns, column_facts, column_profile
from tarnlake.catalog.ddl import (
    clone_table,
    create_external_table,
    drop_partition_columns,
    drop_table,
    partition_columns,
    table_facts,
)
from tarnlake.operators.shape import flatten_struct, normalize_names, project_json
from tarnlake.plans.fixtures import new_database
from tarnlake.session import work_folder
from tarnlake.sinks.files import append_batches, save_delimited, save_parquet, save_text
from tarnlake.sinks.tables import create_database, save_table
from tarnlake.sinks.transfer import copy_dataset
from tarnlake.sources.files import scan_delimited, scan_json_lines, scan_json_texts, scan_text
from tarnlake.sources.staged import unload_scan


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture()
def sample(spark):
    return spark.sql("SELECT id AS k, concat('v', id) AS Name, id % 2 AS p FROM range(10)")


@pytest.fixture()
def db(spark):
    return new_database(spark)


def test_work_folder_is_the_named_one(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    a, b = work_folder(spark), work_folder(spark)
    assert a.startswith(base) and a != b


def test_create_database_twice(spark, db):
    create_database(spark, db)


def test_managed_and_external(spark, db, folder, sample):
    save_table(sample, f"{db}.m")
    save_table(sample, f"{db}.e", path=folder)
    assert table_facts(spark, f"{db}.m")["type"] == "MANAGED"
    assert table_facts(spark, f"{db}.e")["type"] == "EXTERNAL"
    save_table(sample.limit(1), f"{db}.m")
    assert spark.table(f"{db}.m").count() == 1
    drop_table(spark, f"{db}.e")
    drop_table(spark, f"{db}.e")
    assert spark.read.parquet(folder).count() == 10


def test_managed_in_the_current_database(spark, sample):
    name = f"managed_{uuid.uuid4().hex[:8]}"
    for rows in (sample, sample.limit(2)):
        save_table(rows, name)
        assert spark.table(name).count() == rows.count()
    drop_table(spark, name)
    assert not spark.catalog.tableExists(name)


def test_clone_copies_nothing(spark, db, folder, sample):
    save_table(sample, f"{db}.src", path=folder)
    before = set(glob.glob(f"{folder}/*"))
    for how in ("table", "files"):
        clone_table(spark, f"{db}.src", f"{db}.clone", columns_from=how)
        assert spark.table(f"{db}.clone").columns == ["k", "Name", "p"]
        assert table_facts(spark, f"{db}.clone")["location"] == table_facts(spark, f"{db}.src")["location"]
        assert content(spark.table(f"{db}.clone")) == content(sample)
    assert set(glob.glob(f"{folder}/*")) == before
    drop_table(spark, f"{db}.clone")
    assert content(spark.table(f"{db}.src")) == content(sample)


def test_clone_of_partitioned_table(spark, db, folder, sample):
    save_table(sample, f"{db}.src", path=folder, partition_by=["p"])
    for how in ("table", "files"):
        clone_table(spark, f"{db}.src", f"{db}.clone", columns_from=how)
        assert partition_columns(spark, f"{db}.clone") == ["p"]
        assert content(spark.table(f"{db}.clone")) == content(sample)
    assert drop_partition_columns(spark, f"{db}.clone").columns == ["k", "Name"]


def test_external_table_if_not_exists(spark, db, folder, sample):
    save_parquet(sample, folder)
    for _ in range(2):
        create_external_table(spark, f"{db}.x", folder, "k BIGINT, Name STRING, p BIGINT")
    assert content(spark.table(f"{db}.x")) == content(sample)


def test_listing_leaves_out_tables_without_parameters(spark):
    frames = (
        spark.createDataFrame([(1, "db")], "DB_ID int, NAME string"),
        spark.createDataFrame(
            [(1, 1, 11, "a"), (2, 1, 12, "b"), (3, 1, 13, "c")], "TBL_ID int, DB_ID int, SD_ID int, TBL_NAME string"
        ),
        spark.createDataFrame([(11, 21), (12, 22), (13, 23)], "SD_ID int, CD_ID int"),
        spark.createDataFrame(
            [(21, "x", "int"), (21, "y", "string"), (22, "z", "int"), (23, "w", "date")],
            "CD_ID int, COLUMN_NAME string, TYPE_NAME string",
        ),
        spark.createDataFrame(
            [(1, "owner", "me"), (1, "size", "3"), (3, "comment", "hello"), (3, "owner", "me"), (9, "comment", "gone")],
            "TBL_ID int, PARAM_KEY string, PARAM_VALUE string",
        ),
    )
    assert content(catalog_columns(*frames)) == sorted(
        [("db.a", "x", "int"), ("db.a", "y", "string"), ("db.c", "w", "date"), ("db.c", "w", "date")]
    )
    assert content(catalog_columns(*frames, table="db.a")) == [("db.a", "x", "int"), ("db.a", "y", "string")]
    assert catalog_columns(*frames, table="db.b").count() == 0 == catalog_columns(*frames, table="db").count()
    # A name with several dots is the same text, wherever the database ends.
    dotted = (frames[0].withColumn("NAME", F.lit("d.b")), frames[1].withColumn("TBL_NAME", F.lit("t.a")), *frames[2:])
    assert catalog_columns(*dotted, table="d.b.t.a").count() == 4
    assert catalog_columns(*dotted, table="d.b.t").count() == 0


def test_profile(spark):
    df = spark.createDataFrame([(1, "ab", 1.5), (None, "abcd", None), (3, None, 2.5)], "k int, s string, d double")
    rows = [tuple(r) for r in column_profile(df).collect()]
    assert rows == [
        (1, "k", "int", 3, 1, None, "1", "3"),
        (2, "s", "string", 3, 1, 4, "ab", "abcd"),
        (3, "d", "double", 3, 1, None, None, None),
    ]


def test_profile_of_nothing(spark):
    rows = column_profile(spark.createDataFrame([], "k int")).collect()
    assert tuple(rows[0]) == (1, "k", "int", 0, 0, None, None, None)


def test_facts(spark):
    df = spark.createDataFrame([], "k int not null, s string, d decimal(9,2)")
    assert [tuple(r) for r in column_facts(df).orderBy("position").collect()] == [
        (1, "k", "int", None, None, True, False),
        (2, "s", "string", None, None, False, True),
        (3, "d", "decimal(9,2)", 9, 2, True, True),
    ]


def test_normalize_names(spark):
    df = spark.sql("SELECT 1 AS `t.A`, 2 AS B")
    assert normalize_names(df).columns == ["a", "b"]
    with pytest.raises(ValueError):
        normalize_names(spark.sql("SELECT 1 AS `t.A`, 2 AS `u.a`"))


def test_flatten_refuses_clash(spark):
    with pytest.raises(ValueError):
        flatten_struct(spark.sql("SELECT 1 AS a, named_struct('a', 2) AS s"), "s")
    with pytest.raises(TypeError):
        flatten_struct(spark.sql("SELECT 1 AS a"), "a")


def test_project_json_escapes(spark):
    df = spark.createDataFrame([('so"u', 34, "x")], "givenName string, age int, address string")
    out = project_json(df, {"givenName": None, "age": "years"}, init_upper=["givenName"])
    assert out.first().json == '{"givenName":"So\\"u","years":34}'


def test_delimited_round_trip(spark, folder):
    texts = ["a|b", 'say "x"', "line\nbreak", "back\\slash", "\\", "x\\", '"', " blanks ", '\\"', "cr\rlf\r\nz", "#c", "é€"]
    df = spark.createDataFrame([(t, texts[-i]) for i, t in enumerate(texts)], "a string, b string")
    save_delimited(df, folder)
    assert content(scan_delimited(spark, folder, "a string, b string", multi_line=True)) == content(df)


def test_delimited_null_mark(spark, folder):
    df = spark.createDataFrame([("", None), (None, ""), ("x", " ")], "a string, b string")
    save_delimited(df, folder, null_value="\\N")
    assert content(scan_delimited(spark, folder, "a string, b string", null_value="\\N")) == content(df)


def test_text_partition_folders(spark, folder):
    df = spark.sql("SELECT concat('row ', id) AS value, 2020 AS year, id % 2 AS hour FROM range(6)")
    save_text(df, folder, partition_by=["year", "hour"])
    back = scan_text(spark, folder)
    assert back.columns == ["value", "year", "hour"] and content(back.select(*df.columns)) == content(df)
    plan = back.filter("hour = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hour" in plan
    assert content(scan_text(spark, f"{folder}/year=2020/hour=1")) == [("row 1",), ("row 3",), ("row 5",)]


def test_rebalanced_write_splits_a_hot_value(spark, folder):
    hot = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)
    df = spark.range(0, 200000, 1, 8).select("id", F.sha1(F.col("id").cast("string")).alias("v"), hot.alias("p"))
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        save_parquet(df, f"{folder}/a", partition_by=["p"])
        save_parquet(df, f"{folder}/b", partition_by=["p"], rebalance=True)
    finally:
        for key in settings:
            spark.conf.unset(key)
    files = {n: len(glob.glob(f"{folder}/b/p={n}/*.parquet")) for n in range(50)}
    assert files[0] > 1 and sum(files.values()) < len(glob.glob(f"{folder}/a/*/*.parquet")) == 400
    assert spark.read.parquet(f"{folder}/b").select(F.sum("id"), F.count("v")).first() == (200000 * 199999 // 2, 200000)


def test_append_batches(spark, folder, sample):
    assert append_batches([sample, sample.limit(3), sample.limit(0)], folder) == 3
    assert spark.read.parquet(folder).count() == 13


def test_copy_between_formats(spark, folder, sample):
    save_parquet(sample, f"{folder}/a")
    copied = copy_dataset(spark, f"file://{folder}/a", f"file://{folder}/b", target_format="json")
    assert content(copied) == content(sample)
    back = copy_dataset(spark, f"{folder}/b", f"{folder}/c", "json", partition_by=["p"], schema=sample.schema)
    assert content(back.select(*sample.columns)) == content(sample)


def test_copy_keeps_types_of_partition_columns(spark, folder):
    df = spark.createDataFrame([("01", 1, 2.5), ("1", 2, None), (None, 3, 0.5)], "p string, k int, d double")
    save_parquet(df, f"{folder}/a")
    back = copy_dataset(spark, f"{folder}/a", f"{folder}/b", partition_by=["p"])
    assert back.dtypes == df.dtypes and content(back) == content(df)


def test_json_inference_orders_fields(spark, folder):
    spark.sql("SELECT 2 AS z, 'x' AS a").write.json(folder)
    assert scan_json_lines(spark, folder).dtypes == [("a", "string"), ("z", "bigint")]


def test_unload(spark, folder, sample):
    sample.createOrReplaceTempView(f"v_{uuid.uuid4().hex}")
    sample.createOrReplaceTempView("unload_sample")
    out = unload_scan(spark, "unload_sample", folder, "WHERE k >= 8")
    assert content(out) == content(sample.filter("k >= 8"))
    empty = unload_scan(spark, "unload_sample", folder, "WHERE k > 100")
    assert empty.schema.names == sample.columns and empty.count() == 0


def test_json_texts_infer_as_files_do(spark, folder):
    texts = [
        '{"itemId":"a","baseProperties":{"uid":"u","ts":1550887585110},"q":1,"arr":[1,2.5],"n":null,"b":true}',
        '{"q":2.5,"extra":{"x":[{"y":"z"}]},"mix":1}',
        '{"mix":"one"}',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    df.select("t").write.text(folder)
    want = scan_json_lines(spark, folder)
    got = scan_json_texts(df, "t").drop("i")
    assert got.dtypes == want.dtypes
    assert content(got) == content(want)


def test_json_texts_with_schema_and_bad_text(spark):
    df = spark.createDataFrame([(1, '{"a":1}'), (2, "no json"), (3, None)], "i int, t string")
    assert content(scan_json_texts(df, "t")) == [(1, 1), (2, None), (3, None)]
    assert content(scan_json_texts(df, "t", "a string")) == [(1, "1"), (2, None), (3, None)]
    with pytest.raises(ValueError):
        scan_json_texts(df.filter("i > 1"), "t")


def test_clone_keeps_odd_names_and_leading_zeros(spark, folder):
    database = new_database(spark)
    rows = spark.createDataFrame([(1, "007", (5,)), (2, "010", (6,))], "k int, code string, s struct<`a b`: int>")
    save_table(rows, f"{database}.t", path=f"{folder}/it's", partition_by=["code"])
    for columns_from in ("table", "files"):
        clone_table(spark, f"{database}.t", f"{database}.clone", columns_from=columns_from)
        clone = spark.table(f"{database}.clone")
        assert sorted((r.k, r.code, r.s[0]) for r in clone.collect()) == [(1, "007", 5), (2, "010", 6)]


def test_copies_keep_leading_zeros(spark, folder):
    rows = spark.createDataFrame([(1, "007"), (2, "010")], "k int, code string")
    rows.write.partitionBy("code").parquet(f"{folder}/a")
    copied = copy_dataset(spark, f"{folder}/a", f"{folder}/b", partition_by=["code"])
    assert sorted(map(tuple, copied.collect())) == [(1, "007"), (2, "010")]
    assert spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled") == "true"
