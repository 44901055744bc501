"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then twice; the better time counts.  All
rows are produced and thrown away, nothing is sent to the driver.  The total is
that of the registered queries; ``prepared`` times operators alone, over inputs
made beforehand.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tarnlake import versions  # noqa: E402
from tarnlake.operators.mutate import merge_upsert  # noqa: E402
from tarnlake.operators.nested import decode_rows  # noqa: E402
from tarnlake.plans import QUERIES  # noqa: E402
from tarnlake.plans.database import remote_orders  # noqa: E402
from tarnlake.plans.decoding import _measures  # noqa: E402
from tarnlake.session import local_session, work_folder  # noqa: E402
from tarnlake.sources.staged import staged_jdbc_scan  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "staged_jdbc_scan",
    "merge_upsert",
    "merge_upsert_repeated_keys",
    "first_per_key",
    "first_events_by_type",
    "decode_struct",
    "decode_array",
    "decode_leaves",
    "scan_parquet",
    "scan_jsonl_declared",
    "scan_jdbc_partitioned",
    "unload_scan",
    "copy_dataset",
    "catalog_columns",
    "column_profile",
    "update_where",
    "version_diff",
    "total_length",
    "pi_estimate",
]


def staged_orders(spark):
    options, name = remote_orders(spark, SF_DIR)
    return lambda: staged_jdbc_scan(
        spark, options, name, work_folder(spark), partition_column="O_ORDERKEY", num_partitions=8, fetch_size=1000
    )


def merged_lines(spark):
    """A tenth of the line items, with other keys for some, merged into all."""
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    keyed = lines.withColumn("id", F.monotonically_increasing_id())
    path = work_folder(spark)
    keyed.write.parquet(path)
    target = spark.read.parquet(path)
    changes = target.where("id % 10 = 0").withColumn("id", F.col("id") + F.when(F.col("id") % 100 == 0, -1).otherwise(0) * 10**12)
    return lambda: merge_upsert(target, changes, ["id"])


def changed_version(spark):
    """An update of few rows of a stored table of all line items."""
    root = work_folder(spark)
    versions.write_version(spark.read.parquet(f"{SF_DIR}/lineitem.parquet").repartition(40), root)

    def run():
        versions.update_version(spark, root, "l_orderkey = 7", {"l_tax": "0"})
        return versions.read_latest(spark, root)

    return run


def decoded_rows(spark):
    path = work_folder(spark)
    _measures(spark, SF_DIR).write.parquet(path)
    texts = spark.read.parquet(path)
    declared = "array<struct<name:string,amount:double,flags:array<string>>>"
    return lambda: decode_rows(texts, "measures", declared)


PREPARED = {
    "staged_orders": staged_orders,
    "merged_lines": merged_lines,
    "changed_version": changed_version,
    "decoded_rows": decoded_rows,
}


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def best(run) -> float:
    timed(run)
    return round(min(timed(run) for _ in range(2)), 4)


def main() -> None:
    spark = local_session("bench", cores=CPUS, shuffle_partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    load = os.getloadavg()[0]
    seconds = {name: best(lambda name=name: QUERIES[name](spark, SF_DIR)) for name in HEADLINE}
    prepared = {name: best(make(spark)) for name, make in PREPARED.items()}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "prepared": prepared,
                "machine": {"cpus": os.cpu_count(), "load_before": round(load, 2), "threads": CPUS},
            }
        )
    )


if __name__ == "__main__":
    main()
