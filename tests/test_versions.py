"""Laws of versioned tables."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnlake import versions
from tarnlake.operators.conform import common_type


def rows(df):
    return sorted(map(tuple, df.collect()))


def live(spark, root, version):
    """The files that rows of a version come from."""
    rows = versions.read_version(spark, root, version)
    return {r[0] for r in rows.select(F.col("_metadata.file_name")).distinct().collect()}


@pytest.fixture()
def root(spark, folder):
    df = spark.createDataFrame([(i, i * 10) for i in range(10)], "k int, v int")
    versions.write_version(df, folder)
    return folder


def test_older_versions_do_not_change(spark, root):
    before = rows(versions.read_version(spark, root, 0))
    versions.update_version(spark, root, "k = 1", {"v": "-1"})
    versions.delete_version(spark, root, "k > 5")
    source = spark.createDataFrame([(1, 111), (77, 777)], "k int, v int")
    versions.merge_version(spark, root, source, ["k"])
    versions.write_version(spark.createDataFrame([(0, 0)], "k int, v int"), root)
    assert rows(versions.read_version(spark, root, 0)) == before
    assert (1, -1) in rows(versions.read_version(spark, root, 1))
    assert len(rows(versions.read_version(spark, root, 2))) == 6
    assert rows(versions.read_version(spark, root, 3))[-1] == (77, 777)
    assert rows(versions.read_latest(spark, root)) == [(0, 0)]


def test_history(spark, root):
    versions.delete_version(spark, root, "k >= 5")
    found = versions.history(spark, root).orderBy("version").collect()
    assert [(r.version, r.operation, r.parameters, r.row_count) for r in found] == [
        (0, "WRITE", "", 10),
        (1, "DELETE", "k >= 5", 5),
    ]
    assert found[0].committed_at <= found[1].committed_at


def test_unknown_version(spark, root, folder):
    with pytest.raises(ValueError):
        versions.read_version(spark, root, 9)
    with pytest.raises(ValueError):
        versions.read_version(spark, f"{folder}-missing", 0)
    with pytest.raises(ValueError):
        versions.read_latest(spark, f"{folder}-missing")


def test_failed_write_is_not_visible(spark, root):
    bad = spark.sql("SELECT 1 AS k, CAST(raise_error('stop') AS INT) AS v")
    with pytest.raises(Exception, match="stop"):
        versions.write_version(bad, root)
    assert versions.latest_version(spark, root) == 0
    assert versions.write_version(versions.read_latest(spark, root), root) == 1
    assert versions.version_diff(spark, root, 0, 1, ["k"]).first() == (0, 0, 0)


def test_empty_version_keeps_schema(spark, root):
    versions.delete_version(spark, root, "true")
    latest = versions.read_latest(spark, root)
    assert latest.dtypes == [("k", "int"), ("v", "int")] and latest.count() == 0


def test_view_follows_registration(spark, root):
    versions.register_latest(spark, root, "version_view")
    versions.delete_version(spark, root, "k < 9")
    assert spark.table("version_view").count() == 10
    versions.register_latest(spark, root, "version_view")
    assert spark.table("version_view").count() == 1


def test_untouched_files_are_shared(spark, folder):
    df = spark.range(0, 1000, 1, 8).selectExpr("id AS k", "concat('v', id) AS v")
    versions.write_version(df, folder)
    versions.update_version(spark, folder, "k = 3", {"v": "'new'"})
    versions.delete_version(spark, folder, "k = 990")
    source = spark.createDataFrame([(400, "m"), (5000, "n")], "k bigint, v string")
    versions.merge_version(spark, folder, source, ["k"])
    versions.delete_version(spark, folder, "k = -1")
    lists = [live(spark, folder, n) for n in range(5)]
    assert len(lists[0]) == 8
    assert [len(lists[0] & later) for later in lists] == [8, 7, 6, 5, 5]
    assert lists[4] == lists[3]
    want = {i: f"v{i}" for i in range(1000)}
    want.update({3: "new", 400: "m", 5000: "n"})
    del want[990]
    assert dict(map(tuple, versions.read_latest(spark, folder).collect())) == want
    assert [tuple(versions.version_diff(spark, folder, 0, n, ["k"]).first()) for n in range(5)] == [
        (0, 0, 0), (0, 1, 0), (0, 1, 1), (1, 2, 1), (1, 2, 1),
    ]
    assert versions.history(spark, folder).filter("version = 3").first().row_count == 1000


def test_merge_without_a_match_only_adds_files(spark, root):
    source = spark.createDataFrame([(100, 1), (None, 2)], "k int, v int")
    versions.merge_version(spark, root, source, ["k"])
    lists = [live(spark, root, n) for n in range(2)]
    assert lists[0] < lists[1]
    assert versions.read_latest(spark, root).count() == 12


def test_merge_with_repeated_source_key_leaves_no_version(spark, root):
    for key in (1, 100):
        source = spark.createDataFrame([(key, 1), (key, 2)], "k int, v int")
        with pytest.raises(Exception, match="several rows for one key"):
            versions.merge_version(spark, root, source, ["k"])
    assert versions.latest_version(spark, root) == 0


def test_overwrite_may_change_the_schema(spark, root):
    versions.write_version(spark.sql("SELECT 'x' AS other"), root)
    assert versions.read_latest(spark, root).columns == ["other"]
    assert versions.read_version(spark, root, 0).columns == ["k", "v"]


def test_merge_over_different_key_types(spark, folder):
    rows = [(i, f"k{i:02d}", f"2024-01-{i + 1:02d}", i * 1.5) for i in range(20)]
    base = spark.createDataFrame(rows, "a int, b string, c string, n double").withColumn("c", F.col("c").cast("date"))
    versions.write_version(base, folder)
    source = base.filter("a between 5 and 8").withColumn("n", F.lit(-1.0))
    extra = source.limit(1).withColumn("b", F.lit("zz"))
    source = source.unionByName(extra)
    for keys in (["a", "b"], ["b", "c"], ["b"], ["n"]):
        root = f"{folder}-{'-'.join(keys)}"
        versions.write_version(base, root)
        if keys == ["n"]:
            one = source.limit(1).withColumn("n", F.lit(15.0)).withColumn("b", F.lit("hit"))
            versions.merge_version(spark, root, one, keys)
            assert versions.read_latest(spark, root).filter("b = 'hit'").count() == 1
            assert versions.read_latest(spark, root).count() == 20
        else:
            versions.merge_version(spark, root, source, keys)
            assert versions.read_latest(spark, root).filter("n = -1").count() == 5
            assert versions.read_latest(spark, root).count() == 21


def test_merge_of_nothing(spark, root):
    versions.merge_version(spark, root, versions.read_latest(spark, root).limit(0), ["k"])
    assert versions.version_diff(spark, root, 0, 1, ["k"]).first() == (0, 0, 0)
    only_null = spark.createDataFrame([(None, 1)], "k int, v int")
    versions.merge_version(spark, root, only_null, ["k"])
    assert versions.read_latest(spark, root).count() == 11


def test_history_cut_off_before_its_first_row(spark, folder):
    import os

    os.makedirs(f"{folder}/history/_temporary")
    assert versions.latest_version(spark, folder) is None
    assert versions.write_version(spark.range(3), folder) == 0
    assert versions.read_latest(spark, folder).count() == 3


def test_two_writers_are_noticed(spark, root):
    entry = versions.history(spark, root)
    entry.write.mode("append").partitionBy("version").parquet(f"{root}-copy")
    entry.write.mode("append").partitionBy("version").parquet(f"{root}-copy")
    spark.read.parquet(f"{root}-copy").write.partitionBy("version").parquet(f"{root}-two/history")
    with pytest.raises(RuntimeError, match="two writers"):
        versions.read_latest(spark, f"{root}-two")


def test_merge_compares_keys_as_the_targets_type(spark, folder):
    versions.write_version(spark.range(0, 20, 1, 4).selectExpr("CAST(id AS INT) AS k", "'old' AS v"), folder)
    source = spark.createDataFrame([("9", "new"), ("10", "new"), ("100", "new")], "k string, v string")
    versions.merge_version(spark, folder, source, ["k"])
    latest = versions.read_latest(spark, folder)
    assert latest.dtypes == [("k", "int"), ("v", "string")] and latest.count() == 21
    assert sorted(r.k for r in latest.filter("v = 'new'").collect()) == [9, 10, 100]


def test_paths_of_a_read_do_not_grow_with_files(spark, folder, monkeypatch):
    paths = []
    read = type(spark.read).parquet

    def counted(self, *args, **options):
        paths.append([a for a in args if "/data/" in a])
        return read(self, *args, **options)

    monkeypatch.setattr(type(spark.read), "parquet", counted)
    versions.write_version(spark.range(0, 600, 1, 60).selectExpr("id AS k", "id AS v"), folder)
    versions.update_version(spark, folder, "k = 5", {"v": "0"})
    versions.delete_version(spark, folder, "k = 599")
    latest = versions.read_latest(spark, folder)
    assert latest.count() == 599 and len(latest.inputFiles()) == 62
    assert max(map(len, paths)) == 3
    # The test on names takes replaced files off the list; they are not opened.
    assert len(live(spark, folder, 2)) == 60


def test_source_that_differs_each_time(spark, root):
    live_source = spark.range(1, numPartitions=1).select(
        (F.lit(100) + F.floor(F.rand() * 1000)).cast("int").alias("k"), F.lit(1).alias("v")
    )
    for _ in range(4):
        versions.merge_version(spark, root, live_source, ["k"])
    latest = versions.read_latest(spark, root)
    assert latest.count() == latest.select("k").distinct().count() <= 14


def test_diff_over_changed_columns(spark, root):
    added = versions.read_latest(spark, root).filter("k < 9").withColumn("w", F.when(F.col("k") < 2, F.lit("new")))
    versions.write_version(added, root)
    assert tuple(versions.version_diff(spark, root, 0, 1, ["k"]).first()) == (0, 2, 1)
    assert tuple(versions.version_diff(spark, root, 1, 0, ["k"]).first()) == (1, 2, 0)
    versions.write_version(added.withColumnRenamed("v", "x"), root)
    assert tuple(versions.version_diff(spark, root, 1, 2, ["k"]).first()) == (0, 9, 0)
    versions.write_version(added.withColumnRenamed("k", "key"), root)
    with pytest.raises(ValueError, match="no column k"):
        versions.version_diff(spark, root, 0, 3, ["k"])


def test_fully_replaced_folders_leave_the_version(spark, root):
    versions.update_version(spark, root, "true", {"v": "v + 1"})
    entry = versions.history(spark, root).filter("version = 1").first()
    assert len(entry.folders) == 1 and entry.folders[0].replaced == 0 and entry.lists == [] and entry.row_count == 10


def test_diff_over_wider_types(spark, folder):
    narrow = "k int, v smallint, d decimal(5,2), w array<struct<x:int>>, day date"
    wide = "k bigint, v double, d decimal(9,4), w array<struct<x:decimal(20,0)>>, day timestamp_ntz"
    old = spark.sql("SELECT int(id) k, smallint(id) v, decimal(id) / 4 d, array(struct(int(id) AS x)) w, date'2020-02-03' day FROM range(6)")
    versions.write_version(old.selectExpr(*[f"cast({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in narrow.split(", ")]), folder)
    new = versions.read_latest(spark, folder).filter("k < 5")
    new = new.selectExpr(*[f"cast({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in wide.split(", ")])
    changed = {"v": F.when(F.col("k") == 1, 1.5).otherwise(F.col("v")), "d": F.when(F.col("k") == 2, F.col("d") + 0.0001).otherwise(F.col("d"))}
    versions.write_version(new.withColumns({c: v.cast(new.schema[c].dataType) for c, v in changed.items()}), folder)
    assert tuple(versions.version_diff(spark, folder, 0, 1, ["k"]).first()) == (0, 2, 1)
    assert tuple(versions.version_diff(spark, folder, 1, 0, ["k"]).first()) == (1, 2, 0)
    versions.write_version(new.withColumn("k", F.col("k").cast("string")), folder)
    with pytest.raises(TypeError, match="column k is bigint in version 1 .* and string in version 2"):
        versions.version_diff(spark, folder, 1, 2, ["k"])


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("tinyint", "bigint", "bigint"), ("int", "float", "double"), ("smallint", "float", "float"), ("bigint", "double", None),
        ("int", "decimal(4,2)", "decimal(12,2)"), ("decimal(38,0)", "decimal(3,2)", None), ("decimal(3,1)", "double", None),
        ("decimal(9,0)", "double", "double"), ("float", "double", "double"), ("date", "timestamp_ntz", "timestamp_ntz"),
        ("date", "timestamp", None), ("int", "string", None), ("boolean", "int", None), ("varchar(3)", "string", "string"),
        ("map<string,int>", "map<string,bigint>", "map<string,bigint>"), ("struct<a:int>", "struct<b:int>", None),
        ("array<int>", "array<string>", None), ("binary", "string", None),
    ],
)
def test_common_types(a, b, want):
    a, b = (StructType.fromDDL(f"c {t}")["c"].dataType for t in (a, b))
    for found in (common_type(a, b), common_type(b, a)):
        assert (found and found.simpleString()) == want


@pytest.mark.parametrize("named", [1000, 20])
def test_plans_do_not_grow_with_replaced_files(spark, folder, monkeypatch, named):
    monkeypatch.setattr(versions, "NAMED_FILES", named)
    base = spark.range(0, 600, 1, 60).selectExpr("id AS k", "id AS v")
    versions.write_version(base, folder)
    versions.update_version(spark, folder, "k % 10 = 0 AND k < 500", {"v": "-1"})
    source = spark.createDataFrame([(k, -2) for k in (*range(1, 300, 10), 1000)], "k bigint, v bigint")
    versions.merge_version(spark, folder, source, ["k"])
    versions.delete_version(spark, folder, "k >= 590")
    versions.write_version(spark.range(5).selectExpr("id AS k", "id AS v"), folder)
    entries = versions.history(spark, folder).orderBy("version").collect()
    assert [[f.replaced for f in e.folders if f.files == 60] for e in entries] == [[0], [50], [50], [51], []]
    want = {k: k for k in range(600)}
    states = [dict(want)]
    want.update({k: -1 for k in range(0, 500, 10)})
    states.append(dict(want))
    want.update({k: -2 for k in (*range(1, 300, 10), 1000)})
    states.append(dict(want))
    states.append({k: v for k, v in want.items() if not 590 <= k < 1000 and k != 1000})
    for version, state in enumerate(states):
        found = versions.read_version(spark, folder, version)
        assert dict(map(tuple, found.collect())) == state and entries[version].row_count == len(state)
        plan = found._jdf.queryExecution().toString()
        assert named > 20 or plan.count("part-") == 0
    for a, b in ((0, 1), (1, 0), (1, 3), (3, 1), (0, 4), (2, 2)):
        x, y = (states + [{k: k for k in range(5)}])[a], (states + [{k: k for k in range(5)}])[b]
        counts = len(y.keys() - x.keys()), sum(x[k] != y[k] for k in x.keys() & y.keys()), len(x.keys() - y.keys())
        assert tuple(versions.version_diff(spark, folder, a, b, ["k"]).first()) == counts
