"""Shards against prefix sums in plain Python."""

import zlib

from tarnlake.llm import sharding

SCHEMA = "doc_id bigint, text string, size string, part int"


def check(spark, rows, shards, parts=5):
    got = sharding.assign_shards(spark.createDataFrame(rows, SCHEMA).repartition(parts), shards).collect()
    key = lambda d, s, c: (d is not None, d or 0, s, c)
    want = sorted((key(i, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, *_ in rows))
    total, at, out, slots = sum(w[2] for w in want), 0, [], {}
    for _, i, size, crc in want:
        shard = min(shards - 1, (2 * at + size) * shards // (2 * total))
        out.append((i, size, crc, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        at += size
    assert sorted((r.doc_id or 0, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == sorted(out)
    return got


def test_prefix_sums(spark):
    rows = [(i * 7 % 3000, "x" * (i % 97), "k", 1) for i in range(3000)]
    got = check(spark, rows, 24)
    sizes = [sum(r["size"] for r in got if r.shard == s) for s in range(24)]
    assert max(sizes) - min(sizes) <= 2 * 105


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "", 0), (None, "é", "", 0), (None, "é", "", 0), (3, "y" * 100_000, "", 0)]
    check(spark, rows + [(4, "same", "", 0)] * 1500, 24)
    check(spark, rows, 24)
    check(spark, rows, 1)


def test_no_rows(spark):
    assert sharding.assign_shards(spark.createDataFrame([], SCHEMA), 24).collect() == []
