"""The prefix trie against one built in memory, at several shard sizes."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.llm import trie, trie_query
from tarnlake.llm.parentheses import Parentheses
from tarnlake.llm.registry import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string"


def plain(conversations, extra=()):
    """Nodes by sequence of first turns, of {conv_id: [(role, text)]}."""
    members = {}
    for conv_id in [*conversations, *extra]:
        turns = tuple(conversations.get(conv_id, ()))
        for depth in range(len(turns) + 1):
            members.setdefault(turns[:depth], []).append(conv_id)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    rows = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in convs if len(conversations.get(c, ())) == len(node))
        rows.append(
            (
                min(convs),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(convs),
                len(children.get(node, ())),
                sum(n not in children for n in below),
                sum((len(members[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(rows, key=repr)


def collected(nodes):
    return sorted((tuple(r) for r in nodes.collect()), key=repr)


def conversations(seed, count, length, kinds):
    rng = random.Random(seed)
    made = {}
    for conv_id in rng.sample(range(10 * count), count):
        if made and rng.random() < 0.6:
            old = made[rng.choice(list(made))]
            made[conv_id] = old[: rng.randrange(len(old) + 1)]
        else:
            made[conv_id] = []
        made[conv_id] = made[conv_id] + [(rng.choice("ua"), "x" * rng.randrange(kinds)) for _ in range(rng.randrange(1, length))]
    return made


def rows_of(made):
    return [(c, i, role, text, "p") for c, turns in made.items() for i, (role, text) in enumerate(turns)]


def test_find_close():
    rng = random.Random(4)
    for count in (1, 2, 40, 300, 5000):
        for deep in (0.5, 0.9, 0.999):
            opening, depth, left = [], 0, count
            while left or depth:
                if left and (depth == 0 or rng.random() < deep):
                    opening.append(True)
                    depth, left = depth + 1, left - 1
                else:
                    opening.append(False)
                    depth -= 1
            tree, stack, closes = Parentheses(np.array(opening)), [], {}
            for at, is_open in enumerate(opening):
                if is_open:
                    stack.append(at)
                else:
                    closes[stack.pop()] = at
            assert {at: tree.find_close(at) for at in closes} == closes


@pytest.mark.parametrize("cuts", [0, 1, 5, 1000])
def test_shards_add_up(cuts):
    """Entries cut into shards at any place give the nodes of one shard, once spines are added up."""
    for seed in range(12):
        made = conversations(seed, 30, 6, 3)
        by_path = {}
        for conv_id, turns in made.items():
            path, last = [], b""
            for role, text in turns:
                last = hashlib.blake2b(last + f"{role}{text}".encode(), digest_size=16).digest()
                path.append(last)
            by_path.setdefault(tuple(path), []).append((conv_id, [len(t) for _, t in turns]))
        entries = [
            {"path": list(p), "chars": c[0][1], "n_ends": len(c), "conv_id": min(c)[0], "ends_sha256": str(len(c))}
            for p, c in sorted(by_path.items())
        ]
        rng = random.Random(seed)
        bounds = sorted({0, len(entries), *(rng.randrange(len(entries)) for _ in range(cuts))})
        total = {}
        for a, b in zip(bounds, bounds[1:], strict=False):
            columns = trie.encode_shard(entries[a:b], entries[a - 1]["path"] if a else None)
            names = ("n_convs", "n_children", "n_leaves", "saved_tokens")
            for row in zip(columns["node"], columns["spine"], columns["conv_id"], *(columns[c] for c in names), strict=True):
                node, spine, least, *sums = row
                assert node not in total or spine
                old = total.get(node, (least, *[0] * len(sums)))
                total[node] = (min(old[0], least), *(x + y for x, y in zip(old[1:], sums, strict=True)))
        want = [(r[0], *r[3:7]) for r in plain(made)]
        assert sorted(total.values()) == sorted(want)


@pytest.mark.parametrize("size", [None, 300, 20])
def test_trie(spark, monkeypatch, size):
    made = conversations(1, 300, 9, 3)
    made[10**6] = [("u", "xx")] * 40
    made[10**6 + 1] = [("u", "xx")] * 90
    frame = spark.createDataFrame(rows_of(made), SCHEMA).repartition(5)
    extra = [5 * 10**6, 4 * 10**6, *list(made)[:3]]
    members = spark.createDataFrame([(c,) for c in extra], "conv_id bigint")
    if size:
        # More shards and smaller chunks than so few conversations would have.
        ordered = type(frame).repartitionByRange
        monkeypatch.setattr(type(frame), "repartitionByRange", lambda self, n, *c: ordered(self, max(1, 3000 // size) if c else n, *c))
        monkeypatch.setattr(trie, "IDS_PER_CHUNK", 3)
    got = collected(trie.prefix_trie(trie.digest_turns(frame), members))
    assert got == plain(made, [c for c in extra if c not in made])


def test_odd_rows(spark):
    rows = [
        (1, None, "u", "b", "p"),
        (1, 0, None, "c", "p"),
        (1, 5, "u", None, "p"),
        (2, None, "u", "b", "p"),
        (2, 1, "", "c", "p"),
        (2, 1, "", "c", "p"),
        (None, 1, "u", "lost", "p"),
        (3, 7, "u", "y" * 100_000, "p"),
        (4, 7, "u", "y" * 100_000, "p"),
        (-5, 1, "1:u", "", "p"),
    ]
    made = {
        1: [("u", "b"), ("", "c"), ("u", "")],
        2: [("u", "b"), ("", "c"), ("", "c")],
        3: [("u", "y" * 100_000)],
        4: [("u", "y" * 100_000)],
        -5: [("1:u", "")],
    }
    turns = trie.digest_turns(spark.createDataFrame(rows, SCHEMA))
    assert collected(trie.prefix_trie(turns)) == plain(made)
    assert trie.prefix_trie(turns.limit(0)).collect() == []
    ties = spark.createDataFrame([(c, 1, "u", t, "p") for c in (1, 2) for t in ("abc" if c == 1 else "cab")], SCHEMA)
    assert collected(trie.prefix_trie(trie.digest_turns(ties)).agg(F.max("depth"), F.count("*"))) == [(3, 4)]


def test_conversations_without_turns(spark, tmp_path):
    """A conversation whose family has no first one, and which is shorter than what it would borrow, has no turns."""
    rows = [(c, 0, "user", "t", "p") for c in range(201, 230)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    nodes = QUERIES["op12_parentheses_trie"](spark, str(tmp_path)).collect()
    root = [r for r in nodes if r.depth == 0]
    assert len(root) == 1 and root[0].n_convs == 29 and root[0].parent_conv_id is None
    ended = spark.createDataFrame(rows, SCHEMA).where(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6 > 0)
    ids = ",".join(str(r.conv_id) for r in ended.orderBy("conv_id").collect())
    assert root[0].ends_sha256 == hashlib.sha256(ids.encode()).hexdigest()
    assert root[0].n_leaves == root[0].n_children == (1 if ended.count() < 29 else 0)
    assert trie_query.HEADS == 6
