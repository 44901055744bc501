"""Fingerprints of documents from prefix polynomial hashes.

The prefix hash of the first ``i`` code points is the sum of code point times base to the power of its place, modulo a prime; two primes
make 62 bits.  The difference of two entries of this array, shifted by a power of the base, is the hash of the span between them, so any two
spans of any texts are compared in constant time, and the longest common extension of two places is found by binary search.

A fingerprint holds the length, the hash of the whole text, and short hashes of the prefixes and suffixes of a ladder of lengths, eight to an
octave.  Equal texts have equal fingerprints.  The likeness of two fingerprints is the part of the longer text that the longest common prefix and the
longest common suffix cover, each found by binary search over the ladder, and so up to 9 % too short; it is 1 for equal fingerprints only.  A short hash is 16
bits; a rung that is taken for equal by chance is found with a probability of 2 ** -16 for each step of the search.

Defined cases: a null text is empty; all empty texts have one fingerprint, of likeness 1 to itself and 0 to any other; texts of any length are read whole, as
one row, and take about 60 bytes a code point while they are hashed; a null ``doc_id`` is kept; repeated rows have equal fingerprints; an empty table
gives no rows.  Further columns are not carried, whatever their names.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.shingles import mix

PRIMES = (2147483647, 2147483629)
BASES = (1_203_870_911, 871_366_243)
#: Rungs of the ladder in an octave, and bytes of a rung's hash.
RUNGS = 8
RUNG_BYTES = 2
#: Hexadecimal digits of a fingerprint's length and of its hash of the whole text.
LENGTH_DIGITS, WHOLE_DIGITS = 12, 16


class Powers:
    """Powers of the bases and of their inverses, made as far as asked for."""

    def __init__(self):
        self._forward = [np.ones(1, np.uint64) for _ in PRIMES]
        self._back = [np.ones(1, np.uint64) for _ in PRIMES]

    def upto(self, count: int) -> None:
        while len(self._forward[0]) <= count:
            for k, prime in enumerate(PRIMES):
                for table, base in ((self._forward, BASES[k]), (self._back, pow(BASES[k], -1, prime))):
                    step = np.uint64(pow(base, len(table[k]), prime))
                    table[k] = np.concatenate((table[k], table[k] * step % np.uint64(prime)))

    def forward(self, k: int, at) -> np.ndarray:
        return self._forward[k][at]

    def back(self, k: int, at) -> np.ndarray:
        return self._back[k][at]


_powers = Powers()


class PrefixHashes:
    """The prefix arrays of a text."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        self.length = len(points)
        _powers.upto(self.length)
        self.sums = []
        for k, prime in enumerate(PRIMES):
            # Terms stay below 2 ** 31, so their sum fits for texts of up to 2 ** 33 code points.
            terms = points * _powers.forward(k, slice(0, self.length)) % np.uint64(prime)
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms) % np.uint64(prime))))

    def spans(self, start, end) -> np.ndarray:
        """62-bit hashes of the spans from ``start`` to ``end``, numbers or arrays of them; equal spans have equal ones, wherever they are."""
        parts = []
        for k, prime in enumerate(PRIMES):
            prime = np.uint64(prime)
            between = (self.sums[k][end] + prime - self.sums[k][start]) % prime
            parts.append(between * _powers.back(k, start) % prime)
        return parts[0] << np.uint64(31) | parts[1]


def same_span(a: PrefixHashes, start: int, b: PrefixHashes, other: int, length: int) -> bool:
    return bool(a.spans(start, start + length) == b.spans(other, other + length))


def common_extension(a: PrefixHashes, start: int, b: PrefixHashes, other: int) -> int:
    """How many code points from ``start`` in one text and from ``other`` in the other on are the same, by binary search."""
    low, high = 0, min(a.length - start, b.length - other)
    while low < high:
        middle = (low + high + 1) // 2
        if same_span(a, start, b, other, middle):
            low = middle
        else:
            high = middle - 1
    return low


class Joined:
    """The first ``cut`` code points of one text, and then the first ``more`` of another, hashed from the arrays of both."""

    def __init__(self, first: PrefixHashes, cut: int, second: PrefixHashes, more: int):
        self.length = cut + more
        _powers.upto(self.length)
        self.first, self.cut, self.second = first, cut, second

    def spans(self, start, end) -> np.ndarray:
        start, end = np.broadcast_arrays(np.asarray(start), np.asarray(end))
        parts = []
        for k, prime in enumerate(PRIMES):
            prime = np.uint64(prime)
            here, there = self.first.sums[k], self.second.sums[k]
            shift = _powers.forward(k, self.cut)

            def upto(at):
                beyond = there[np.maximum(at - self.cut, 0)] * shift % prime
                return (here[np.minimum(at, self.cut)] + beyond) % prime

            parts.append((upto(end) + prime - upto(start)) % prime * _powers.back(k, start) % prime)
        return parts[0] << np.uint64(31) | parts[1]


_LADDER = np.unique(np.floor(2.0 ** (np.arange(34 * RUNGS) / RUNGS)).astype(np.int64))


def ladder(length: int) -> np.ndarray:
    """Lengths from 1 up to ``length``, each at most 9 % longer than the one before or by 1; the same for all texts as far as they go."""
    return _LADDER[: np.searchsorted(_LADDER, length, "right")]


def fingerprint(hashes: PrefixHashes | Joined) -> str:
    """Length, hash of the whole, and hashes of the ladder's prefixes and suffixes, as text."""
    n = hashes.length
    whole = int(hashes.spans(0, n))
    lengths = ladder(n)
    # Prefixes and suffixes of a length in turn.
    starts = np.stack((np.zeros(len(lengths), np.int64), n - lengths), axis=1).reshape(-1)
    spans = hashes.spans(starts, starts + np.repeat(lengths, 2))
    short = (mix(spans) >> np.uint64(48)).astype("<u2")
    return f"{n:0{LENGTH_DIGITS}x}{whole:0{WHOLE_DIGITS}x}" + base64.b64encode(short.tobytes()).decode()


def _read(text: str) -> tuple[int, np.ndarray]:
    rungs = np.frombuffer(base64.b64decode(text[LENGTH_DIGITS + WHOLE_DIGITS :]), dtype="<u2").reshape(-1, 2)
    return int(text[:LENGTH_DIGITS], 16), rungs


def _highest(a: np.ndarray, b: np.ndarray) -> int:
    """How many first rungs are the same, by binary search: what differs on one rung differs on all above."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[middle - 1] == b[middle - 1]:
            low = middle
        else:
            high = middle - 1
    return low


def likeness(a: str, b: str) -> float:
    """The part of the longer text that the common prefix and suffix of two fingerprinted texts cover: 1 if they are equal, else less."""
    if a == b:
        return 1.0
    (n, rungs), (m, others) = _read(a), _read(b)
    longer = max(n, m)
    lengths = ladder(min(n, m))
    covered = 0
    for side in (0, 1):
        high = _highest(rungs[:, side], others[:, side])
        covered += int(lengths[high - 1]) if high else 0
    # They differ somewhere, so one code point at least is not covered.
    return min(covered, longer - 1) / longer


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars`` and ``fingerprint`` of every row."""

    def made(batches):
        for batch in batches:
            hashes = map(PrefixHashes, batch.column("text").to_pylist())
            rows = [(h.length, fingerprint(h)) for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), pa.array([f for _, f in rows], pa.string())],
                ["doc_id", "n_chars", "fingerprint"],
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(made, "doc_id bigint, n_chars bigint, fingerprint string")
