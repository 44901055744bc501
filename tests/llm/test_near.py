"""Near duplicates: sketches, exactness against all pairs, components."""

import random

import numpy as np
import pytest

from tarnlake.llm import near
from tarnlake.llm.components import connected
from tarnlake.llm.shingles import shingle_set

SCHEMA = "doc_id bigint, text string, kept string, component_id int"


def plain(rows, size, percent):
    """Components by comparing all pairs of sets of word sequences."""
    sets = []
    for row in rows:
        words = (row[1] or "").encode().lower().split()
        n = min(size, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i):
            if a[0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                x, y = sorted((find(a[0]), find(rows[j][0])))
                parent[y] = x
    return sorted(
        ((r[0], len(s), None if r[0] is None else find(r[0]), r[0] is None or find(r[0]) == r[0]) for r, s in zip(rows, sets)),
        key=str,
    )


def family(draw, first, count, words, edits):
    base = [f"w{draw.randrange(10**6)}" for _ in range(words)]
    rows = []
    for k in range(count):
        own = list(base)
        for _ in range(draw.randrange(edits + 1)):
            own[draw.randrange(words)] = f"e{draw.randrange(10**6)}"
        rows.append((first + k, " ".join(own), "x", k))
    return rows


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    rows = [r for f in range(12) for r in family(draw, 100 * f, 12, 30 + 20 * f, 5)]
    rows += family(draw, 5000, 150, 60, 4)
    rows += [(9000, None, None, None), (9001, "", None, 1), (9002, " \t\n", None, 1), (9003, "one", "k", 1), (9004, "ONE ", "k", 1)]
    rows += [(9005, "one two", "k", 1), (9006, "one two", "k", 1), (None, "one two", None, 1), (None, rows[0][1], None, 1)]
    rows += [(9007, "a b c d e f g", "", 0), (9007, "a b c d e f g", "", 0), (9007, "h i j k l m n", "", 0), (9008, "h i j k l m n", "", 0)]
    return rows + [(9100 + i, "x " * 40_000 + f"tail{i // 3}", "", 0) for i in range(6)]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_components_equal_all_pairs(spark, rows, size, percent, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_DOCUMENTS", 40)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = near.near_components(frame, size, percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, size, percent)


@pytest.mark.parametrize("leaders", [False, True])
def test_large_groups(spark, monkeypatch, leaders):
    """Families, chains whose ends aren't similar, and template texts that share bands without a link, in groups of many blocks."""
    monkeypatch.setattr(near, "BLOCK_DOCUMENTS", 8)
    monkeypatch.setattr(near, "LEADERS", leaders)
    draw = random.Random(7)
    rows = family(draw, 0, 60, 60, 3) + family(draw, 1000, 40, 200, 30)
    chain = [f"c{i}" for i in range(80)]
    for i in range(40):
        chain[2 * i] = f"d{i}"
        rows.append((2000 + i, " ".join(chain), "x", i))
    page = [f"p{i}" for i in range(60)]
    rows += [(3000 + i, " ".join([*page, *(f"own{i}-{k}" for k in range(25))]), "x", i) for i in range(60)]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = near.near_components(frame, 3, 85).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, 3, 85)


def test_a_family_needs_few_pairs_of_blocks(spark, monkeypatch):
    """Nodes linked to one leader never meet each other in pairs of blocks, even where some aren't linked to it."""
    monkeypatch.setattr(near, "BLOCK_DOCUMENTS", 16)
    met, compared = [], near._compared_blocks

    def counted(held, *args):
        met.append(sum(len(r.others) for r in held.select("others").collect()))
        return compared(held, *args)

    monkeypatch.setattr(near, "_compared_blocks", counted)
    draw = random.Random(3)
    rows = family(draw, 0, 400, 300, 3)
    base = rows[0][1].split()
    for k in range(5):
        # Near to some of the family only.
        own = list(base)
        for at in draw.sample(range(300), 8):
            own[at] = f"u{k}-{at}"
        rows.append((1000 + k, " ".join(own), "x", k))
    found = near.near_components(spark.createDataFrame(rows, SCHEMA), 5, 80).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(rows, 5, 80)
    # All pairs of 26 blocks would be 405 * 26 rows.
    assert sum(met) < 405 * 8, met


def test_clashing_names(spark, rows):
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    for name in ("dropped", "node", "band", "component"):
        frame = frame.withColumn(name, near.F.lit(1))
    left = near.drop_near_duplicates(frame, 5, 80)
    assert left.columns == frame.columns and left.count() == sum(r[3] for r in plain(rows, 5, 80))


def test_drop_keeps_one_of_each(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    left = near.drop_near_duplicates(frame, 5, 80)
    assert left.columns == frame.columns
    want = sorted((r[0] for r in plain(rows, 5, 80) if r[3]), key=str)
    assert sorted((r.doc_id for r in left.collect()), key=str) == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near.near_components(empty).collect() == [] and near.drop_near_duplicates(empty).collect() == []


def test_sketches_fill_and_estimate():
    draw = np.random.default_rng(2)
    small = [np.unique(draw.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 5, 40, 3000)]
    assert (near.sketch(small) != near._EMPTY).all()
    for share in (0.5, 0.85):
        errors = []
        for _ in range(40):
            common = draw.integers(0, 2**63, int(400 * share), dtype=np.uint64)
            rest = draw.integers(0, 2**63, 400 - len(common), dtype=np.uint64)
            cut = len(rest) // 2
            a, b = near.sketch([np.concatenate([common, rest[:cut]]), np.concatenate([common, rest[cut:]])], 120)
            errors.append((a == b).mean() - share)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_bands_meet_their_bound():
    for percent in (80, 85, 95):
        rows = near.band_rows(percent)
        assert (1 - (percent / 100) ** rows) ** (near.COORDINATES // rows) <= near.MISS


def test_shingles():
    assert len(shingle_set(b"A b\x0bc\nd", 3)) == 2
    assert (shingle_set(b"A b C", 3) == shingle_set(b" a B c ", 3)).all()
    assert len(shingle_set(b"", 3)) == 0 and len(shingle_set(b"a b", 3)) == 1
    assert shingle_set("É x y".encode(), 3) != shingle_set("é x y".encode(), 3)


def test_connected_paths_and_stars(spark):
    edges = [(i + 1, i) for i in range(1, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (-5, 7000)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 1 for i in range(2, 201)} | {1000 + i: 1000 for i in range(1, 300)} | {7000: -5}
    assert got == want
