"""Aggregates, one row per key, partitions: results and plans."""

import pytest
from pyspark.sql import functions as F

from tarnlake.functions import text
from tarnlake.operators.summarize import first_per_key, heavy_keys, partition_sizes, pi_estimate, sum_reduce, total_length


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sum(spark):
    df = spark.createDataFrame([(i,) for i in (8, -3, 21, 40, None)], "n int")
    assert sum_reduce(df, "n").first()[0] == 66
    assert sum_reduce(df.filter("n < 10"), "n").first()[0] == 5


def test_pi_points_do_not_repeat_early(spark):
    index = spark.range(1, 2001).select(F.explode(F.array("id", F.col("id") + 1_000_000_000, F.col("id") + 10**18)).alias("i"))
    exact = [0, 0]
    for i in range(1, 2001):
        for k in (i, i + 1_000_000_000, i + 10**18):
            x, y = ((k * step % 10**10) / 1e10 * 2 - 1 for step in (7548776662, 5698402909))
            exact[0] += 1
            exact[1] += x * x + y * y <= 1
    found = pi_estimate(index, "i").first()
    assert [found.points, found.inside] == exact


def test_first_per_key_limits_before_the_shuffle(spark, folder):
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).alias("k"), (30000 - F.col("id")).alias("o"), "id"
    )
    rows.write.parquet(folder)
    out = first_per_key(spark.read.parquet(folder), ["k"], ["o", "id"])
    plan = plan_of(out)
    shuffle = plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan[shuffle:]
    got = {r.k: r.o for r in out.collect()}
    want = {}
    for i in range(30000):
        k = 7 if i % 3 == 0 else i % 100
        want[k] = min(want.get(k, 10**9), 30000 - i)
    assert got == want


def test_first_per_key_null_key_and_null_order(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), (1, None), (1, 5)], "k int, o int")
    assert sorted(map(tuple, first_per_key(df, ["k"], ["o"]).collect()), key=repr) == [(1, None), (None, 1)]


def test_pi_of_ten_million_points_repeats(spark):
    points = spark.range(1, 1_000_000, numPartitions=10)
    row = pi_estimate(points, "id").first()
    assert row.points == 999_999 and abs(row.pi - 3.14159265) < 1e-3
    assert pi_estimate(points.repartition(3), "id").first() == row


def test_pi_index_may_be_huge(spark):
    points = spark.range(9_000_000_000_000_000_000, 9_000_000_000_000_100_000)
    assert abs(pi_estimate(points, "id").first().pi - 3.14159265) < 1e-2


def test_count_reads_no_columns(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert "ReadSchema: struct<>" in plan_of(lines.agg(F.count(F.lit(1))))


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    from tarnlake.plans import QUERIES

    plan = plan_of(QUERIES["scan_parquet"](spark, sf_dir))
    assert "GreaterThan(l_discount,0.05)" in plan and "l_extendedprice" not in plan


def test_partition_sizes(spark):
    rows = partition_sizes(spark.range(100).repartition(4)).collect()
    assert len(rows) == 4 and sum(r.rows for r in rows) == 100


def test_total_length(spark):
    df = spark.createDataFrame([("ab",), (None,), ("čd€",)], "value string")
    assert total_length(df).first()[0] == 5


def test_total_length_in_utf16_units(spark):
    df = spark.createDataFrame([("ab",), (None,), ("č😀€",)], "value string")
    assert total_length(df, utf16=True).first()[0] == 6 and total_length(df).first()[0] == 5


def test_text_functions(spark):
    df = spark.createDataFrame([("soufiane x",), ("",), (None,), (":a:b",), ("a:b:c",), ("db.t.c",), ("x.y.",)], "t string")
    t = F.col("t")
    out = df.select(
        text.init_upper(t), text.before_first(t), text.last_token(t), text.count_char(t, ":"), text.tail(t, 2)
    ).collect()
    assert [tuple(r) for r in out] == [
        ("Soufiane x", "soufiane x", "soufiane x", 0, " x"),
        ("", "", "", 0, ""),
        (None, None, None, None, None),
        (":a:b", ":a:b", ":a:b", 2, ":b"),
        ("A:b:c", "a", "a:b:c", 2, ":c"),
        ("Db.t.c", "db.t.c", "c", 0, ".c"),
        ("X.y.", "x.y.", "y", 0, "y."),
    ]
    digits = spark.createDataFrame([("decimal(10,2)",)], "t string").select(text.digit_groups(t)).first()[0]
    assert digits == ["10", "2"]


def test_strip_blanks(spark):
    df = spark.createDataFrame([("\t a b\r\n ",), (" ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.strip_blanks(F.col("t"))).collect()] == ["a b", "", "", None]


def test_row_text(spark):
    df = spark.createDataFrame([(1, None, "x")], "a int, b int, c string")
    assert df.select(text.row_text("a", "b", "c")).first()[0] == "1,null,x"


@pytest.mark.parametrize("share", [0.5, 0.05, 0.002])
def test_heavy_keys_are_all_listed(spark, share):
    """Shares near the border, among as many keys as rows, over many tasks."""
    rows = spark.range(0, 40000, 1, 13).select(
        F.when(F.col("id") % 2 == 0, F.lit(None)).when(F.col("id") % 20 == 1, F.lit("hot")).when(F.col("id") % 500 == 3, F.lit("warm"))
        .otherwise(F.concat(F.lit("k"), "id")).alias("k"),
        F.lit(None).cast("int").alias("rows of"),
    )
    counts = {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    want = {k: n for k, n in counts.items() if n >= share * 40000}
    got = heavy_keys(rows, ["k", "rows of"], share)
    assert {r["k"]: r["rows"] for r in got.collect()} == want and len(want) == {0.5: 1, 0.05: 2, 0.002: 3}[share]
    assert got.columns == ["k", "rows of", "rows"]


def test_heavy_keys_of_nothing(spark):
    assert heavy_keys(spark.range(0), ["id"], 0.1).collect() == []
    assert heavy_keys(spark.range(5), ["id"], 0.3).collect() == []
    with pytest.raises(ValueError):
        heavy_keys(spark.range(5), ["id"], 0)
