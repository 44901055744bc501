"""Each row and the one after it, in descending order of ids, over all partitions.

Rows are dealt to buckets by ranges of ids, whose bounds the driver learns as a few quantiles.  An id that fills several buckets is split
over them by a hash of the text, which is the order among rows of one id.  The first row of every bucket is copied to the end of the
bucket before it, so that each bucket, sorted, holds every one of its rows next to its successor.

Rows cross the network once.  Besides them a bucket gets one row.

Defined cases: a null id comes last; rows with the same id come in the order of a hash of their texts, and then of the texts; the last row of
all is followed by the first, which is itself if it is alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one bucket, and of one as small as it may be where there are fewer.
ROWS_PER_BUCKET = 4000
LEAST_ROWS = 1000
#: Buckets of one task, on average: several, as they are dealt by a hash.
BUCKETS_PER_TASK = 8
#: Most buckets: the driver and every task know their bounds, and one row of numbers for each is broadcast.
MOST_BUCKETS = 100_000
#: Rows that are turned to Python strings at once.
ROWS_AT_ONCE = 256
#: What a null id counts as.
NO_ID = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the order: ``key`` ascends as ids descend, ``tie`` tells rows of one id apart."""
    doc_id, text = F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit(""))
    key = F.bitwise_not(F.coalesce(doc_id, F.lit(NO_ID)))
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), key.alias("key"), F.xxhash64(text).alias("tie"))


def _bounds(rows: DataFrame) -> list[int]:
    """Keys at equal numbers of rows apart; a key that fills several buckets is there several times."""
    count = rows.count()
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    buckets = min(MOST_BUCKETS, max(1, min(count // LEAST_ROWS, max(4 * BUCKETS_PER_TASK * parallel, count // ROWS_PER_BUCKET))))
    shares = [i / buckets for i in range(1, buckets)]
    if not shares:
        return []
    return rows.agg(F.percentile_approx("key", shares, 100 * buckets)).first()[0]


def _bucketed(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """The rows with their ``bucket``; buckets follow each other in the order of key and tie."""
    if not bounds:
        return rows.withColumn("bucket", F.lit(0))

    @F.pandas_udf("int")
    def bucket(keys: pd.Series, ties: pd.Series) -> pd.Series:
        known = np.array(bounds, dtype=np.int64)
        values = keys.to_numpy(dtype=np.int64)
        low, high = np.searchsorted(known, values, "left"), np.searchsorted(known, values, "right")
        # Rows whose key is a bound, once or more, lie in all buckets that it ends or begins, by their tie.
        share = (ties.to_numpy(dtype=np.int64) >> 33) + (1 << 30)
        return pd.Series(low + ((high - low + 1) * share >> 31) * (high > low))

    return rows.withColumn("bucket", bucket("key", "tie"))


def _pairs(batches):
    """(doc_id, text, next text) of rows sorted by bucket and place, of which each bucket's last one is a copy of what follows."""
    bucket, name, text = None, None, None
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS_AT_ONCE):
            some = batch.slice(first, ROWS_AT_ONCE)
            columns = (some.column(c).to_pylist() for c in ("bucket", "doc_id", "text"))
            for at, doc_id, own in zip(*columns, strict=True):
                if at == bucket:
                    yield name, text, own
                bucket, name, text = at, doc_id, own


def _texts(pairs):
    while some := list(itertools.islice(pairs, ROWS_AT_ONCE)):
        columns = zip(*some, strict=True)
        kinds = (pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "text", "next_text"])


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (empty for null) and ``next_text`` of every row."""
    return map_pairs(docs, _texts, "doc_id bigint, text string, next_text string")


def map_pairs(docs: DataFrame, make: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """What ``make`` yields as Arrow batches from ``(doc_id, text, next text)`` of all rows of a task."""

    def made(batches):
        return make(_pairs(batches))

    rows = _keyed(docs)
    bounds = _bounds(rows)
    rows = _bucketed(rows, bounds)
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("first")).select("bucket", "first.key", "first.tie")
    # One row of numbers per bucket, `MOST_BUCKETS` at most: for one task to sort, and to broadcast.
    order = Window.orderBy("bucket")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(whole))
    firsts = firsts.withColumn("before", before)
    heads = rows.join(F.broadcast(firsts), ["bucket", "key", "tie"]).groupBy("before").agg(F.min("text").alias("text"))
    copies = heads.select(F.col("before").alias("bucket"), F.lit(1).alias("after"), F.lit(None).cast("bigint").alias("doc_id"), "text")
    nothing = F.lit(0).cast("bigint")
    both = rows.withColumn("after", F.lit(0)).unionByName(copies.withColumns({"key": nothing, "tie": nothing}))
    order = ["bucket", "after", "key", "tie", "text"]
    dealt = both.repartition(max(1, (len(bounds) + 1) // BUCKETS_PER_TASK), "bucket").sortWithinPartitions(*order)
    return dealt.select("bucket", "doc_id", "text").mapInArrow(made, schema)
