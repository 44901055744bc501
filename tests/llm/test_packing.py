"""Packing: every id once and in place, few sequences, balanced cost."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarnlake.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, length string, start int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([1, 7, 64]))
def test_assign(lengths, capacity):
    pieces = packing.assign(lengths, capacity, 1.0, 0.01)
    used = defaultdict(int)
    at = defaultdict(int)
    for document, start, length, sequence, offset in pieces:
        assert length > 0 and offset == used[sequence]
        used[sequence] += length
    for document, start, length, _, _ in sorted(pieces):
        assert start == at[document]
        at[document] += length
    assert [at[d] for d in range(len(lengths))] == lengths
    assert all(n <= capacity for n in used.values()) and len(used) <= -(-sum(lengths) // capacity)


def test_costs_are_balanced():
    draw = np.random.default_rng(1)
    lengths = draw.integers(20, 400, 3000).tolist()
    costs = defaultdict(float)
    for _, _, n, sequence, _ in packing.assign(lengths, 2048, 1.0, 1 / 512):
        costs[sequence] += n + n * n / 512
    naive, at = defaultdict(float), 0
    for n in sorted(lengths, reverse=True):
        naive[at // 2048] += n + n * n / 512
        at += n
    assert np.std(list(costs.values())) < 0.5 * np.std(list(naive.values()))


def test_pieces_hold_the_ids_of_whole_texts(spark):
    rows = [(i, "some words of a text " * (i % 50), "k", 1) for i in range(300)]
    rows += [(1000, None, None, None), (1001, "", "", 0), (None, "no id", "", 0), (1002, "long é " * 60_000, "", 0)]
    rows += [(1003, "twice", "", 0), (1003, "twice", "", 0)]
    rows += [(1004, "a <|endoftext|> b\n\n  c \t|x| ", "", 0)]
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH).collect()
    library = Tokenizer.from_file(PATH)
    want = sorted(
        (str(i), zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4").tobytes()))
        for i, t, *_ in rows
    )
    by_document, used = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        by_document[(p.doc_id, p.doc_tokens)].append(p)
        used[p.sequence_id].append((p.offset, p.length))
    got = []
    for (doc_id, tokens), parts in by_document.items():
        copies = sum(p.start == 0 for p in parts)
        parts = parts if copies == 1 else [p for p in parts if p.start == 0][:1]
        ids = b"".join(bytes(p.ids) for p in sorted(parts, key=lambda p: p.start))
        assert len(ids) == 4 * tokens
        got += [(str(doc_id), zlib.crc32(ids))] * copies
    assert sorted(got) == want
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []
