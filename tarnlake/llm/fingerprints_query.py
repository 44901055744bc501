"""Query 11: fingerprints of all documents, and of each with its second half replaced by the beginning of the next."""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm.fingerprints import Joined, PrefixHashes, fingerprint, likeness
from tarnlake.llm.registry import query, table
from tarnlake.llm.successors import ROWS_AT_ONCE, map_pairs

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
DDL = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(pairs):
    known, hashes, print_ = None, None, None
    for doc_id, text, after in pairs:
        if known is None or text != known:
            hashes = PrefixHashes(text)
            print_ = fingerprint(hashes)
        following = PrefixHashes(after)
        next_print = fingerprint(following)
        n = hashes.length
        cut, more = n - n // 2, min(n // 2, following.length)
        edited_print = fingerprint(Joined(hashes, cut, following, more))
        digest = hashlib.sha256((text[:cut] + after[:more]).encode()).hexdigest()
        yield doc_id, n, digest, print_, edited_print, likeness(print_, edited_print), likeness(print_, next_print)
        # Mostly the next row is the one that follows.
        known, hashes, print_ = after, following, next_print


def _compared(pairs):
    rows = _rows(pairs)
    while some := list(itertools.islice(rows, ROWS_AT_ONCE)):
        columns = zip(*some, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    return map_pairs(docs, _compared, DDL)


@query("op11_prefix_hash_fingerprints")
def prefix_hash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
