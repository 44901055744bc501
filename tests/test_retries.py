"""Results with tasks that fail the first time and are run again."""

import os
import subprocess
import sys

JOB = """
from pyspark import TaskContext
from pyspark.sql import functions as F
from tarnlake import operators, sinks, versions
from tarnlake.session import local_session, work_folder

spark = local_session("retries", cores="4,4", shuffle_partitions=4)
spark.sparkContext.setLogLevel("OFF")


@F.udf("bigint")
def flaky(value):
    # Every task fails once, half way through.
    if TaskContext.get().attemptNumber() == 0 and value % 1000 == 500:
        raise RuntimeError("first attempt")
    return value


root = work_folder(spark)
rows = spark.range(0, 8000, 1, 8).select(flaky("id").alias("k"), (F.col("id") % 10).alias("g"))
assert versions.write_version(rows, root) == 0
changes = spark.range(7000, 9000, 1, 4).select(flaky("id").alias("k"), F.lit(-1).cast("bigint").alias("g"))
assert versions.merge_version(spark, root, changes, ["k"]) == 1
counts = [r.row_count for r in versions.history(spark, root).orderBy("version").collect()]
assert counts == [8000, 9000], counts
latest = versions.read_latest(spark, root)
assert latest.agg(F.count("k"), F.countDistinct("k"), F.sum("k")).first() == (9000, 9000, 8999 * 4500)
assert latest.filter("g = -1").count() == 2000
assert tuple(versions.version_diff(spark, root, 0, 1, ["k"]).first()) == (1000, 1000, 0)

sinks.append_batches([rows, rows], root + "-append")
assert spark.read.parquet(root + "-append").count() == 16000
sinks.save_parquet(rows, root + "-parts", partition_by=["g"], rebalance=True)
assert spark.read.parquet(root + "-parts").agg(F.sum("k")).first()[0] == 7999 * 4000
first = operators.first_per_key(rows, ["g"], ["k"])
assert sorted(map(tuple, first.collect())) == [(i, i) for i in range(10)]
print("all right")
"""


def test_jobs_survive_failed_tasks():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run(
        [sys.executable, "-c", JOB],
        cwd=root,
        env={**os.environ, "PYTHONPATH": root},
        capture_output=True,
        text=True,
        timeout=300,
    )
    assert "all right" in done.stdout, done.stderr[-3000:]
