"""Periodic runs against brute force over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnlake.llm import runs, runs_query
from tarnlake.llm.registry import QUERIES, table


def brute(words, exponent=4, least=6):
    """Every stretch in which words some distance apart are equal, under its smallest distance."""
    found = {}
    for period in range(1, len(words) // exponent + 1):
        at = 0
        while at + period < len(words):
            start = at
            while at + period < len(words) and words[at] == words[at + period]:
                at += 1
            length = at - start + period
            if at > start and length >= max(least, exponent * period):
                found.setdefault((start, length), period)
            at += at == start
    return sorted((s, n, q) for (s, n), q in found.items())


def ordered(found):
    return sorted((r.start, r.length, r.period) for r in found)


words = st.lists(st.integers(0, 3), max_size=50)


@settings(max_examples=300, deadline=None)
@given(words, st.integers(2, 4), st.integers(1, 7))
def test_automaton_equals_brute_force(some, exponent, least):
    assert ordered(runs.runs_of(some, exponent, least)) == brute(some, exponent, least)


@settings(max_examples=200, deadline=None)
@given(st.lists(words, max_size=5), st.lists(st.tuples(st.integers(1, 9), st.integers(1, 40)), max_size=3), st.integers(2, 5), st.integers(1, 7))
def test_texts_side_by_side(texts, loops, exponent, least):
    texts = [[b"%d" % w for w in t] for t in texts]
    texts += [[b"%d" % (i % period) for i in range(length)] for period, length in loops]
    texts += [texts[0] + texts[-1]] if texts else []
    got = runs.find(texts, exponent, least)
    assert [ordered(f) for f in got] == [brute(t, exponent, least) for t in texts]


def test_long_texts():
    rng = random.Random(3)
    fresh = [rng.randrange(40) for _ in range(900)]
    mixed = fresh + [fresh[i % 131] for i in range(700)] + fresh[:50] + [7] * 30 + [i % 2 for i in range(41)] + fresh
    for some in (mixed, [1] * 3000, [i % 700 for i in range(3000)], [bin(i).count("1") % 2 for i in range(2048)]):
        texts = [[b"%d" % w for w in some]]
        assert ordered(runs.find(texts, 4, 6)[0]) == brute(some)
        assert ordered(runs.find(texts, 2, 5)[0]) == brute(some, 2, 5)


def test_last_occurrences_follow_the_words():
    some = [random.Random(5).randrange(3) for _ in range(120)]
    automaton = runs.LastOccurrences()
    for end, word in enumerate(some, 1):
        segments = automaton.append(word)
        # The longest words before ``end`` that end at each earlier place and at no later one.
        want, longest = [], 0
        for before in range(end - 1, 0, -1):
            same = 0
            while same < before and some[before - 1 - same] == some[end - 1 - same]:
                same += 1
            if same > longest:
                want.append((end - before, same))
                longest = same
        assert sorted(segments) == want


def test_without_the_automaton_there_are_no_runs(monkeypatch):
    monkeypatch.setattr(runs.LastOccurrences, "append", lambda self, word: [])
    assert runs.find([[b"a"] * 20], 4, 6) == [[]]


def test_odd_rows(spark):
    rows = [
        (1, None, "x"),
        (None, "a a a a a a", "x"),
        (2, "", None),
        (3, " \t\n", "x"),
        (4, "b\x0ba\x0cb a\rb a b a", "x"),
        (4, "b\x0ba\x0cb a\rb a b a", "x"),
        (5, "a a " * 6, "x"),
        (6, "word " * 100_000, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs string")
    got = sorted(runs.find_runs(docs).collect(), key=repr)
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [
        (1, 0, [], ""),
        (2, 0, [], ""),
        (3, 0, [], ""),
        (4, 8, [(0, 8, 2)], "b a"),
        (4, 8, [(0, 8, 2)], "b a"),
        (5, 6, [(0, 6, 1)], "a a"),
        (6, 100_000, [(0, 100_000, 1)], "word"),
        (None, 6, [(0, 6, 1)], "a"),
    ]
    assert runs.find_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.find_runs(docs, exponent=1)


def expected(doc_id, text):
    some = (text or "").encode().split()
    n = len(some)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        some = [some[i] if i < a else some[a + (i - a) % p] for i in range(n)]
    found = brute(some)
    kept = [w for i, w in enumerate(some) if not any(s + q <= i < s + m for s, m, q in found)]
    s, m, q = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    digest = lambda data: hashlib.sha256(data).hexdigest()
    return (len(found), s, m, q, 1000 * m // q if found else None, digest(listed.encode()), digest(b" ".join(kept)))


def test_query_against_brute_force(spark, sf_dir):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_automaton_runs"](spark, sf_dir).collect()}
    assert got == {r.doc_id: expected(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()}
    assert any(r[0] for r in got.values())


def test_query_over_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a a a a a a"), (7, None), (7, None), (8, "")], "doc_id bigint, text string")
    got = {(r.doc_id, r.n_runs, r.start, r.exponent_milli) for r in runs_query.longest_runs(docs).collect()}
    assert got == {(None, 1, 0, 6000), (7, 0, None, None), (8, 0, None, None)}
    assert runs_query.longest_runs(docs.limit(0)).collect() == []
