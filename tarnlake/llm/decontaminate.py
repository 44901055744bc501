"""Benchmark decontamination: windows of a benchmark item's size, found by SimHash and verified by weighted shingles.

Words are runs of letters and digits (every non-ASCII character counts as a letter) in lower case; shingles are five words, or
all of an item that has fewer.  A shingle weighs as many bytes as its words have.  For an item of n words the windows of a document are its runs of n words, or the
whole of a shorter document.

* A window that shares no shingle with any item is similar to none, so only windows around shared shingles are looked at.
* Each of them gets a SimHash, the signs of sums over its shingles' bits, in which a shingle that is there n times counts as the square root
  of n times its weight.  The cosine of two such sums is the weight that the multisets share by the mean of theirs, so uneven weights and
  repeated shingles move a fingerprint no farther than even ones: at the threshold the cosine is 8/9 or more and about 10 of 64 bits differ.
* Items are indexed by four blocks of 16 bits: a fingerprint within radius r of an item's differs from it by r // 4 bits or fewer in one
  block at least, and a table lists for every value of a block the items that near.  So no item within the radius is missed, and
  what lies beyond it is no candidate: of windows at the threshold about one in a thousand, of more similar ones fewer.
* A candidate is verified by the weighted Jaccard similarity of the two multisets of shingles.

Items come to the driver as a stream, which holds one block of bounded number and size at a time.  A block is sent out with a pass
over the documents, whose results are stored before the next one's, so no plan grows with the items.

Defined cases: texts of any length are read whole; null and empty texts, and items without words, match nothing; rows that repeat an id, or have none, are judged by themselves; of
windows with equal similarity the first counts; an empty table on either side gives no matches; further columns are not
carried by `find_matches` and are kept by `drop_contaminated`, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.shingles import sequence_hashes, word_hashes
from tarnlake.session import work_folder

WORDS = 5
SIMILARITY = 0.8
#: Bits in which the fingerprints of a window and an item may differ.
RADIUS = 19
BLOCKS, BLOCK_BITS = 4, 16
#: Items and bytes of text sent to the executors at once.
MOST_ITEMS, MOST_BYTES = 1000, 8_000_000
#: Windows of one document whose bits are summed at once.
MOST_WINDOWS = 20_000
_FILTER = 1 << 20
_SEPARATE = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
SCHEMA = "doc_id bigint, item_id bigint, similarity double, hamming int, first_word bigint, n_words bigint"


def plain_words(text: bytes) -> bytes:
    """The text in lower case with blanks in place of all ASCII but letters and digits."""
    lower = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return lower.translate(_SEPARATE)


def shingle_weights(lengths: np.ndarray, size: int) -> np.ndarray:
    """Bytes of each run of ``size`` words."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    return total[size:] - total[:-size]


def _signs(shingles: np.ndarray) -> np.ndarray:
    """The bits of each hash as -1 and 1, one row each."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """64-bit numbers of the signs of sums, one row each."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


def bag_sums(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum over the bits of a multiset's shingles, each as the square root of all its weight."""
    distinct, first, count = np.unique(shingles, return_index=True, return_counts=True)
    return (_signs(distinct) * _root(count * weights[first])[:, None]).sum(axis=0)


def _root(weights: np.ndarray) -> np.ndarray:
    """Square roots in 1024ths, whole numbers: sums of them don't depend on their order."""
    return np.rint(np.sqrt(weights) * 1024).astype(np.int64)


def window_prints(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, wide: int) -> np.ndarray:
    """The fingerprints of the windows of ``wide`` shingles from ``starts`` on, which ascend."""
    low, high = int(starts[0]), int(starts[-1]) + wide
    sums = np.zeros((high - low + 1, 64), dtype=np.int64)
    np.cumsum(_signs(shingles[low:high]) * _root(weights[low:high])[:, None], axis=0, out=sums[1:])
    prints = fingerprints(sums[starts - low + wide] - sums[starts - low])
    # Windows that hold a shingle twice, as its next place is within reach, are summed one by one.
    order = np.argsort(shingles[low:high], kind="stable")
    again = shingles[low:high][order][1:] == shingles[low:high][order][:-1]
    first, gap = order[:-1][again], np.diff(order)[again]
    reach = np.zeros(high - low + 2, dtype=np.int64)
    near = gap < wide
    np.add.at(reach, np.maximum(first[near] + gap[near] - wide + 1, 0), 1)
    np.add.at(reach, first[near] + 1, -1)
    for i in np.flatnonzero(np.cumsum(reach)[starts - low] > 0).tolist():
        start = int(starts[i])
        prints[i] = fingerprints(bag_sums(shingles[start : start + wide], weights[start : start + wide])[None, :])[0]
    return prints


@dataclass
class Item:
    """A benchmark item: its id, number of words, and shingles with their counts and weights."""

    item_id: int
    n_words: int
    size: int
    shingles: np.ndarray
    weights: np.ndarray
    bag: dict[int, tuple[int, int]] = field(default_factory=dict)

    def similarity(self, shingles: np.ndarray, weights: np.ndarray) -> float:
        """Weighted Jaccard similarity with a window."""
        there: dict[int, tuple[int, int]] = {}
        for shingle, weight in zip(shingles.tolist(), weights.tolist(), strict=True):
            there[shingle] = (there.get(shingle, (0, 0))[0] + 1, weight)
        common = sum(min(n, self.bag[s][0]) * w for s, (n, w) in there.items() if s in self.bag)
        total = int(weights.sum()) + int(self.weights.sum()) - common
        return common / total if total else 0.0


def make_item(item_id: int, text: bytes) -> Item | None:
    plain = plain_words(text)
    words = word_hashes(plain)
    if not len(words):
        return None
    size = min(WORDS, len(words))
    shingles = sequence_hashes(words, size)
    weights = shingle_weights(np.array(list(map(len, plain.split()))), size)
    item = Item(item_id, len(words), size, shingles, weights)
    for shingle, weight in zip(shingles.tolist(), weights.tolist(), strict=True):
        item.bag[shingle] = (item.bag.get(shingle, (0, 0))[0] + 1, weight)
    return item


class ItemIndex:
    """Finds the items of one block in texts."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.items = [item for item in (make_item(i, t) for i, t in rows) if item]
        self.sizes = sorted({item.size for item in self.items})
        self.lengths = np.array([item.n_words for item in self.items], dtype=np.int64)
        pairs = sorted({(s, k) for k, item in enumerate(self.items) for s in item.shingles.tolist()})
        self._shingles = np.array([s for s, _ in pairs], dtype=np.uint64)
        self._of = np.array([k for _, k in pairs], dtype=np.int64)
        self._filter = np.zeros(_FILTER, dtype=bool)
        self._filter[(self._shingles & np.uint64(_FILTER - 1)).astype(np.int64)] = True
        sums = [bag_sums(item.shingles, item.weights) for item in self.items]
        self.prints = fingerprints(np.array(sums).reshape(-1, 64)) if sums else np.zeros(0, "<u8")
        near = np.bitwise_count(np.arange(1 << BLOCK_BITS, dtype=np.uint16)) <= RADIUS // BLOCKS
        values = np.arange(1 << BLOCK_BITS, dtype=np.int64)
        self._tables = [
            np.packbits(near[values[:, None] ^ self._block(self.prints, b)[None, :]], axis=1) for b in range(BLOCKS)
        ]

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)

    def within_radius(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a fingerprint and an item whose fingerprints differ in `RADIUS` bits at most."""
        packed = self._tables[0][self._block(prints, 0)]
        for b in range(1, BLOCKS):
            packed = packed | self._tables[b][self._block(prints, b)]
        window, item = np.nonzero(np.unpackbits(packed, axis=1, count=len(self.items)))
        near = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[near], item[near]

    def _shared(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of shingles that an item has, and that item, for each such item."""
        at = np.flatnonzero(self._filter[(shingles & np.uint64(_FILTER - 1)).astype(np.int64)])
        first = np.searchsorted(self._shingles, shingles[at], "left")
        count = np.searchsorted(self._shingles, shingles[at], "right") - first
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(at, count), self._of[np.repeat(first, count) + inner]

    def matches(self, text: bytes) -> list[tuple[int, float, int, int, int]]:
        """For each item that a window is similar to: ``(item_id, similarity, hamming, first word, words)`` of the best window."""
        plain = plain_words(text)
        words = word_hashes(plain)
        best: dict[int, tuple[float, int, int, int]] = {}
        weights = None
        for size in self.sizes:
            if len(words) < size:
                continue
            shingles = sequence_hashes(words, size)
            at, item = self._shared(shingles)
            if not len(at):
                continue
            lengths = np.array(list(map(len, plain.split())))
            weights = shingle_weights(lengths, size)
            for n_words in np.unique(self.lengths[item]).tolist():
                of_size = self.lengths[item] == n_words
                self._compare(shingles, weights, at[of_size], n_words, size, best)
        return [(self.items[k].item_id, *found) for k, found in sorted(best.items())]

    @staticmethod
    def _around(at: np.ndarray, wide: int, last: int) -> np.ndarray:
        """Starts of the windows that hold one of the positions."""
        covered = np.zeros(last + 2, dtype=np.int64)
        np.add.at(covered, np.clip(at - wide + 1, 0, last), 1)
        np.add.at(covered, np.clip(at, 0, last) + 1, -1)
        return np.flatnonzero(np.cumsum(covered)[: last + 1] > 0)

    def _compare(self, shingles, weights, at, n_words, size, best) -> None:
        """Compares the windows of ``n_words`` words that hold a shingle at one of the positions."""
        wide = min(n_words - size + 1, len(shingles))
        starts = self._around(at, wide, len(shingles) - wide)
        for a in range(0, len(starts), MOST_WINDOWS):
            some = starts[a : a + MOST_WINDOWS]
            low, high = int(some[0]), int(some[-1]) + wide
            if high - low > 2 * MOST_WINDOWS + wide:
                # Far apart: the sums of what lies between aren't needed.
                cuts = np.flatnonzero(np.diff(some) > wide) + 1
                parts = np.split(some, cuts)
            else:
                parts = [some]
            for part in parts:
                self._compare_run(shingles, weights, part, wide, n_words, size, best)

    def _compare_run(self, shingles, weights, starts, wide, n_words, size, best) -> None:
        prints = window_prints(shingles, weights, starts, wide)
        for window, k in zip(*(x.tolist() for x in self.within_radius(prints)), strict=True):
            item = self.items[k]
            if item.n_words != n_words:
                continue
            start = int(starts[window])
            similar = item.similarity(shingles[start : start + wide], weights[start : start + wide])
            if similar >= SIMILARITY and similar > best.get(k, (0.0,))[0]:
                hamming = int(np.bitwise_count(prints[window] ^ self.prints[k]))
                best[k] = (similar, hamming, start, min(n_words, wide + size - 1))


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items in lists of bounded number and size."""
    block, size = [], 0
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("bigint"), F.col("text").cast("binary"))
    for item_id, text in rows.toLocalIterator():
        if block and (len(block) == MOST_ITEMS or size + len(text) > MOST_BYTES):
            yield block
            block, size = [], 0
        block.append((item_id, bytes(text)))
        size += len(text)
    if block:
        yield block


def _matcher(block: list[tuple[int, bytes]]):
    def run(batches):
        index = ItemIndex(block)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            rows = [
                (name, *match)
                for name, text in zip(names, batch.column("text"), strict=True)
                for match in index.matches(text.as_py())
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
            names = ("doc_id", "item_id", "similarity", "hamming", "first_word", "n_words")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def find_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item of which the document has a similar window: the most similar one."""
    texts = docs.where("text is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")
    )
    spark = docs.sparkSession
    folder, count = work_folder(spark), 0
    for block in item_blocks(benchmark):
        texts.mapInArrow(_matcher(block), SCHEMA).write.parquet(f"{folder}/{count}")
        count += 1
    if not count:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*[f"{folder}/{i}" for i in range(count)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that have a window similar to an item."""
    blocks = item_blocks(benchmark)
    first, second = next(blocks, None), next(blocks, None)
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    if first is None:
        return docs
    if second is None:
        return docs.where(~_contaminated(first)(text))
    # A text is contaminated wherever it is: each pass stores the digests of those it finds.
    spark, folder, count = docs.sparkSession, work_folder(docs.sparkSession), 0
    texts = docs.select(text.alias("text")).where("text <> X''")
    for block in itertools.chain([first, second], blocks):
        found = texts.where(_contaminated(block)("text")).select(_digest(F.col("text")).alias("digest"))
        found.distinct().write.parquet(f"{folder}/{count}")
        count += 1
    found = spark.read.schema("digest binary").parquet(*[f"{folder}/{i}" for i in range(count)]).distinct()
    return docs.join(found, _digest(text) == found["digest"], "left_anti")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _contaminated(block: list[tuple[int, bytes]]):
    @F.pandas_udf("boolean")
    def contaminated(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = ItemIndex(block)
        for some in texts:
            yield pd.Series([bool(index.matches(bytes(text))) for text in some], dtype=bool)

    return contaminated
