"""Connected components of a distributed graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.session import work_folder


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def stored(rows: DataFrame, path: str) -> DataFrame:
    """The rows, written and read back.

    Besides cutting the lineage this lets adaptive execution split a hot key of a join with an aggregate, which it can't while the
    aggregate runs in the join's own stage.
    """
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _hook(edges: DataFrame, path: str) -> DataFrame:
    """Edges from each end's larger neighbours, and from itself, to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{path}/large")
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where("a <> b").distinct()
    # No hot key here: a node has at most as many smaller neighbours as it had links to smaller nodes.
    smallest = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(smallest, "a")
    hooked = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooked.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for all nodes but those smallest ones themselves.

    ``edges`` has two columns of ids, ``a`` and ``b``.  Rounds go through the shared work folder; their number grows with the
    logarithm of the longest path.  Nothing but a count and a checksum comes to the driver.
    """
    folder = work_folder(edges.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before, turn = None, 0
    while True:
        now = stored(now, f"{folder}/edges={turn}")
        state = _state(now)
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before, turn, now = state, turn + 1, _hook(now, f"{folder}/turn={turn}")
