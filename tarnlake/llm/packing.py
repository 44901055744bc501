"""Cost-balanced packing of documents into sequences of bounded length.

The cost of a piece of n tokens is taken as ``linear * n + quadratic * n * n``: projections grow with the tokens,
attention within a document with their square.  Documents are taken in blocks of bounded size, as they are read, so that packing
needs no shuffle and a task holds one block.  Within a block each document gives full sequences of its own as
often as it can; what is left is taken in descending order, each remainder to the sequence of lowest cost so far
that has room for it.  Where none has, it is cut and the sequence with the most room is filled.  A block gets as
few sequences as can hold its tokens, so padding is less than one sequence a block.

A sequence is named by its partition and a number within it.  A task that is run again reads the same
rows in the same order and gives the same sequences.

Defined cases: a null text is empty; every document ends with `END_ID`, so an empty one has one token; a null ``doc_id``
and repeated rows are documents like any other; a document of any length is cut into pieces; an empty table gives no
rows.  Further columns of the input are not carried, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.encoding import TextEncoder, slices, worker_encoder

END_ID = 1
ID_BYTES = 4
#: Tokens and documents packed together.  More gives less padding and takes more memory, about 12 bytes a token.
BLOCK_TOKENS = 2_000_000
BLOCK_DOCUMENTS = 20_000
#: Sequences of one partition are numbered from its number times this.
SEQUENCES_PER_PARTITION = 1 << 32
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, `offset` bigint"


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of documents of the given lengths.

    Sequences are numbered from 0, as few as can hold all, each filled without gaps.
    """
    cost = lambda n: linear * n + quadratic * n * n
    pieces = []
    sequence = 0
    left = []
    for document, length in enumerate(lengths):
        full = length // capacity
        for k in range(full):
            pieces.append((document, k * capacity, capacity, sequence, 0))
            sequence += 1
        if length % capacity:
            left.append((-(length % capacity), document, full * capacity))
    open_sequences = -(-sum(-n for n, _, _ in left) // capacity)
    used = np.zeros(open_sequences, dtype=np.int64)
    costs = np.zeros(open_sequences, dtype=np.float64)
    heapq.heapify(left)
    while left:
        negative, document, start = heapq.heappop(left)
        length = -negative
        room = capacity - used
        fits = room >= length
        if fits.any():
            at = int(np.argmin(np.where(fits, costs, np.inf)))
        else:
            at = int(np.argmax(room))
            heapq.heappush(left, (int(room[at]) - length, document, start + int(room[at])))
            length = int(room[at])
        pieces.append((document, start, length, sequence + at, int(used[at])))
        used[at] += length
        costs[at] += cost(length)
    return pieces


def _blocks(batches, encoder: TextEncoder, end: bytes):
    """Lists of (doc_id, ids) of bounded size, a longer document with what came before it."""
    block, tokens = [], 0
    for batch in batches:
        names = batch.column("doc_id").to_pylist()
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts):
            for name, ids in zip(names[a:b], encoder.ids(texts[a:b]), strict=True):
                block.append((name, ids + end))
                tokens += len(block[-1][1]) // ID_BYTES
                if tokens >= BLOCK_TOKENS or len(block) >= BLOCK_DOCUMENTS:
                    yield block
                    block, tokens = [], 0
    if block:
        yield block


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1.0 / 4096,
) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in its sequence, and its ids.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit numbers, ``doc_tokens`` the document's number of
    tokens with the end mark.  ``tokenizer`` is a vocabulary file that every executor has.  ``quadratic`` is the attention
    cost relative to ``linear``; by default attention over 4096 tokens costs as much as their projections.
    """

    def packed(batches):
        encoder, end = worker_encoder(TextEncoder, tokenizer), np.array([END_ID], dtype="<u4").tobytes()
        base = TaskContext.get().partitionId() * SEQUENCES_PER_PARTITION
        for block in _blocks(batches, encoder, end):
            lengths = [len(ids) // ID_BYTES for _, ids in block]
            pieces = assign(lengths, capacity, linear, quadratic)
            for a in range(0, len(pieces), 4096):
                some = pieces[a : a + 4096]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([block[d][0] for d, *_ in some], pa.int64()),
                        "start": pa.array([s for _, s, *_ in some], pa.int64()),
                        "length": pa.array([n for _, _, n, _, _ in some], pa.int64()),
                        "ids": pa.array([block[d][1][s * ID_BYTES : (s + n) * ID_BYTES] for d, s, n, _, _ in some], pa.binary()),
                        "doc_tokens": pa.array([lengths[d] for d, *_ in some], pa.int64()),
                        "sequence_id": pa.array([base + q for *_, q, _ in some], pa.int64()),
                        "offset": pa.array([o for *_, o in some], pa.int64()),
                    }
                )
            base += 1 + max(q for *_, q, _ in pieces)

    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return wanted.mapInArrow(packed, SCHEMA)


def sequences(pieces: DataFrame) -> DataFrame:
    """Length and estimated cost terms of each sequence of `pack`."""
    return pieces.groupBy("sequence_id").agg(
        F.count("*").alias("pieces"), F.sum("length").alias("tokens"), F.sum(F.col("length") * F.col("length")).alias("squares")
    )
