"""Laws of update, delete, merge and diff."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tarnlake.operators.mutate import delete_where, diff_counts, merge_upsert, update_where

SCHEMA = "k int, v string, n bigint"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_update_sees_old_values_and_keeps_types(spark):
    df = frame(spark, [(1, "a", 10), (2, None, 20)])
    out = update_where(df, "k = 1", {"n": "n + k", "k": "n"})
    assert out.schema == df.schema
    assert content(out) == content(frame(spark, [(10, "a", 11), (2, None, 20)]))


def test_update_null_condition_leaves_row(spark):
    df = frame(spark, [(1, None, 10), (2, "x", 20)])
    assert content(update_where(df, "v = 'x'", {"n": "0"})) == content(frame(spark, [(1, None, 10), (2, "x", 0)]))


def test_update_false_condition_is_identity(spark):
    df = frame(spark, [(1, "a", 10), (None, None, None)])
    assert content(update_where(df, F.lit(False), {"n": "0", "v": "'z'"})) == content(df)


def test_update_struct_field(spark):
    df = spark.createDataFrame([Row(i=1, s=Row(a=1, b="x")), Row(i=2, s=Row(a=2, b="y"))])
    out = update_where(df, "i = 2", {"s.a": "s.a + 40", "s.b": "'z'"})
    assert [tuple(r.s) for r in out.orderBy("i").collect()] == [(1, "x"), (42, "z")]


def test_update_unknown_column(spark):
    with pytest.raises(ValueError):
        update_where(frame(spark, []), "k = 1", {"nope": "1"})


def test_delete_null_condition_keeps_row(spark):
    df = frame(spark, [(1, None, 1), (2, "x", 2), (3, "y", 3)])
    assert content(delete_where(df, "v = 'x'")) == content(frame(spark, [(1, None, 1), (3, "y", 3)]))


def test_merge_updates_inserts_and_keeps(spark):
    target = frame(spark, [(1, "a", 1), (2, "b", 2)])
    source = frame(spark, [(2, None, 22), (3, "c", 33)])
    want = frame(spark, [(1, "a", 1), (2, None, 22), (3, "c", 33)])
    assert content(merge_upsert(target, source, ["k"])) == content(want)


def test_merge_repeated_target_keys_are_all_updated(spark):
    target = frame(spark, [(1, "a", 1), (1, "b", 2), (2, "c", 3)])
    out = merge_upsert(target, frame(spark, [(1, "z", 9)]), ["k"])
    assert content(out) == content(frame(spark, [(1, "z", 9), (1, "z", 9), (2, "c", 3)]))


def test_merge_null_keys_never_match(spark):
    target = frame(spark, [(None, "a", 1)])
    source = frame(spark, [(None, "b", 2), (None, "c", 3)])
    assert content(merge_upsert(target, source, ["k"])) == content(target.unionByName(source))


def test_merge_two_keys_one_null(spark):
    target = frame(spark, [(1, "a", 1), (1, None, 2)])
    source = frame(spark, [(1, "a", 10), (1, None, 20)])
    want = frame(spark, [(1, "a", 10), (1, None, 2), (1, None, 20)])
    assert content(merge_upsert(target, source, ["k", "v"])) == content(want)


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_merge_repeated_source_key_fails(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        target = frame(spark, [(1, "a", 1)])
        for key in (1, 5):
            source = frame(spark, [(key, "b", 2), (key, "c", 3)])
            with pytest.raises(ValueError, match=rf"several rows for one key: \({key},\)"):
                merge_upsert(target, source, ["k"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("target", [[], [(9, "a", 1)]])
def test_merge_repeated_source_key_fails_without_a_match(spark, target):
    source = frame(spark, [(1, "b", 2), (1, "c", 3)])
    with pytest.raises(ValueError, match="several rows for one key"):
        merge_upsert(frame(spark, target), source, ["k"])


def test_merge_is_idempotent(spark):
    target = frame(spark, [(i, f"v{i}", i) for i in range(50)])
    source = frame(spark, [(i, f"s{i}", -i) for i in range(0, 100, 3)])
    once = merge_upsert(target, source, ["k"])
    assert content(merge_upsert(once, source, ["k"])) == content(once)


def test_merge_empty_sides(spark):
    empty, some = frame(spark, []), frame(spark, [(1, "a", 1)])
    assert content(merge_upsert(empty, some, ["k"])) == content(some)
    assert content(merge_upsert(some, empty, ["k"])) == content(some)


def test_merge_key_columns_only(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert content(merge_upsert(a, b, ["k"])) == [(1,), (2,), (3,)]


def test_merge_hot_key_is_split(spark, folder):
    """A third of the target shares one key; the join must split it and stay right."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
        spark.range(150000).select(hot.alias("k"), F.concat(F.lit("v"), "id").alias("v")).write.parquet(folder)
        target = spark.read.parquet(folder)
        source = spark.range(1, 200000, 2).select(F.col("id").alias("k"), F.lit("new").alias("v"))
        merged = merge_upsert(target, source, ["k"])
        rows = merged.groupBy("v").count().filter("v = 'new'").first()["count"]
        hits = target.join(source.select("k"), "k", "left_semi").count()
        keys = target.select("k").distinct().join(source.select("k"), "k", "left_semi").count()
        assert rows == hits + 100000 - keys
        merged.collect()
        assert "skew=true" in merged._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_small_source_is_not_shuffled_against_target(spark, folder):
    spark.range(100000).select(F.col("id").alias("k"), F.lit("x").alias("v")).write.parquet(f"{folder}/t")
    spark.createDataFrame([(1, "a"), (-1, "b")], "k bigint, v string").write.parquet(f"{folder}/s")
    target, source = spark.read.parquet(f"{folder}/t"), spark.read.parquet(f"{folder}/s")
    plan = merge_upsert(target, source, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [k" in plan and "LeftOuter" in plan and "SortMergeJoin" not in plan
    assert "Exchange hashpartitioning" not in plan


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan parquet")


def test_merge_reads_its_source_once(spark, folder):
    spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("v")).write.parquet(f"{folder}/t")
    target = spark.read.parquet(f"{folder}/t")
    live = spark.range(1, numPartitions=1).select(F.floor(F.rand() * 2000).alias("k"), F.uuid().alias("v"))
    merged = merge_upsert(target, live, ["k"])
    assert scans(merged) == 3
    rows = merged.collect()
    assert rows == merged.collect() and len({r.k for r in rows}) == len(rows) in (1000, 1001)
    assert [len(r.v) for r in rows if r.v != "x"] == [36]


def test_diff_counts(spark):
    old = frame(spark, [(1, "a", 1), (2, "b", 2), (3, None, 3), (None, "n", 0)])
    new = frame(spark, [(1, "a", 1), (2, "B", 2), (4, "d", 4), (3, None, 3), (None, "n", 0)])
    assert tuple(diff_counts(old, new, ["k"]).first()) == (1, 1, 0)
    assert tuple(diff_counts(new, old, ["k"]).first()) == (0, 1, 1)
    assert tuple(diff_counts(old, old, ["k"]).first()) == (0, 0, 0)


def test_diff_counts_repeated_keys(spark):
    old = frame(spark, [(1, "a", 1), (1, "a", 1), (1, "b", 2)])
    new = frame(spark, [(1, "a", 1), (1, "c", 2), (1, "d", 4)])
    assert tuple(diff_counts(old, new, ["k"]).first()) == (0, 2, 0)
