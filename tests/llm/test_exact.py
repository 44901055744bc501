"""Exact duplicates against a dictionary of stripped texts."""

import re
from collections import defaultdict

from tarnlake.llm import exact

SCHEMA = "doc_id bigint, text string, kept string, head int"


def plain(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", row[1] or "")].append(row)
    out = []
    for group in groups.values():
        best = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out += [(r[0], best[0], len(group)) for r in group]
    return sorted(out, key=str)


def rows():
    base = "x" * 31 + "é" + "word " * 3000
    rows = [(i, base[: 20 + 400 * (i % 9)] + (" \n\t" * (i % 4)) + str(i % 3), "k", i) for i in range(200)]
    rows += [(300, None, None, None), (301, "", "a", 1), (302, " \x0b\x0c\r", "a", 1), (None, "x", "a", 1), (None, "x ", "a", 1)]
    rows += [(400, "x\xa0", "a", 1), (400, "x\xa0", "a", 1), (401, "x \xa0", "a", 1), (7, "x", "b", 2)]
    rows += [(500 + i, "y" * 300_000 + ("z" if i else ""), None, None) for i in range(3)]
    return rows + [(1000 + i, "hot" * 50, "h", 0) for i in range(500)]


def test_marks(spark):
    frame = spark.createDataFrame(rows(), SCHEMA).repartition(7)
    got = exact.mark_duplicates(frame)
    assert got.columns == ["doc_id", "text", "head", "keep_id", "group_size", "kept"]
    got = got.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == plain(rows())
    kept = defaultdict(list)
    for r in got:
        kept[re.sub("[\x20\x09-\x0d]", "", r.text or "")] += [r.kept]
        assert not r.kept or r.doc_id == r.keep_id
    assert all(sum(k) == 1 for k in kept.values())


def test_drops(spark):
    frame = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    left = exact.drop_duplicates(frame)
    assert left.columns == frame.columns
    texts = [re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in left.collect()]
    assert sorted(texts) == sorted({re.sub("[\x20\x09-\x0d]", "", r[1] or "") for r in rows()})


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact.mark_duplicates(empty).collect() == [] and exact.drop_duplicates(empty).collect() == []
