"""Periodic runs of words: stretches that repeat with a smallest period, and the texts with each run cut to one period.

A suffix automaton reads the words of a stretch one by one.  Its link tree is a link-cut tree whose preferred paths are the
states with the same last occurrence: appending word ``i`` accesses the state of the prefix, which recolours the path to
the root, one segment per earlier last occurrence ``j``, in O(log n) segments a word, amortised.  A segment whose deepest state has
length ``L`` says that the last ``L`` words before ``i`` also end at ``j``, and that no more do.  If ``L`` reaches the distance ``i - j``,
two copies touch: a square of that period, repeated to the left as far as ``L`` goes.  While a run lasts, every word
confirms its start and period, so the last confirmation is its end.  The distance is the smallest period, as a smaller one
would be a later last occurrence.

Only stretches that can hold a run are read by the automaton.  Inside a run of period ``q``, every window of a few words after the first
period occurred at most ``q`` words before, and such windows follow each other ``(exponent - 1) * q`` words long.  So a window whose
last occurrence is farther back than that share of its stretch breaks the stretch; this is repeated until nothing breaks,
over many texts at once in numpy.  The test is exact: it leaves out no run.

A text is worked on by one task.  It takes about 20 bytes a word, and a stretch in the automaton about 600 bytes a word.

Defined cases: a null or empty text has no words and no runs and collapses to an empty text; a null ``doc_id`` is
kept; texts of any length are read whole, as one row; runs that tie in start come in the order of their periods; repeated rows give repeated
results; an empty table gives no rows.  Further columns are not carried, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.encoding import slices
from tarnlake.llm.shingles import mix

SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"
#: Most words of the windows that tell stretches without runs.
WINDOW = 3
_STEP = np.uint64(0x9E3779B97F4A7C15)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Run(NamedTuple):
    start: int
    length: int
    period: int


class LastOccurrences:
    """A suffix automaton that knows for each state where its words occurred last.

    States are numbered from 1, the empty one; 0 is none.  ``left``, ``right`` and ``up`` are the splay trees of the preferred paths,
    ordered by depth; ``up`` of a splay root is the path's parent.  ``last`` holds at splay roots, for their whole path.
    """

    def __init__(self):
        self.length, self.link = [0, 0], [0, 0]
        self.next: list[dict] = [{}, {}]
        self.left, self.right, self.up, self.last = [0, 0], [0, 0], [0, 0], [0, 0]
        self.state, self.words = 1, 0

    def _new(self, length: int, moves: dict) -> int:
        self.length.append(length)
        self.next.append(moves)
        for column in (self.link, self.left, self.right, self.up, self.last):
            column.append(0)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up

        def rotate(x: int, p: int) -> None:
            g = up[p]
            if left[p] == x:
                child = left[p] = right[x]
                right[x] = p
            else:
                child = right[p] = left[x]
                left[x] = p
            if child:
                up[child] = p
            up[p], up[x] = x, g
            if g:
                if left[g] == p:
                    left[g] = x
                elif right[g] == p:
                    right[g] = x

        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if not g or (left[g] != p and right[g] != p):
                self.last[x] = self.last[p]
                rotate(x, p)
                return
            top = up[g]
            if not top or (left[top] != g and right[top] != g):
                self.last[x] = self.last[g]
            if (left[g] == p) == (left[p] == x):
                rotate(p, g)
                rotate(x, p)
            else:
                rotate(x, p)
                rotate(x, g)

    def _extend(self, word: int) -> int:
        """The state of all words so far with one more, hung below its link."""
        length, link, moves = self.length, self.link, self.next
        p = self.state
        new = self.state = self._new(length[p] + 1, {})
        while p and word not in moves[p]:
            moves[p][word] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = moves[p][word]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                # The shorter words of q also end here: they become a state above q, so far with the same last occurrence.
                clone = self._new(length[p] + 1, dict(moves[q]))
                while p and moves[p].get(word) == q:
                    moves[p][word] = clone
                    p = link[p]
                link[clone], link[q], link[new] = link[q], clone, clone
                self._splay(q)
                above = self.left[q]
                self.left[clone], self.left[q], self.up[clone] = above, clone, q
                if above:
                    self.up[above] = clone
        self.up[new] = link[new]
        return new

    def append(self, word: int) -> list[tuple[int, int]]:
        """For each earlier last occurrence on the way to the root: how far back it lies, and how many words end there too."""
        path = self._extend(word)
        self.words += 1
        now, segments = self.words, []
        last, right, up = self.last, self.right, self.up
        v = up[path]
        while v:
            self._splay(v)
            before = last[v]
            if before:
                segments.append((now - before, self.length[v]))
            deeper = right[v]
            if deeper:
                last[deeper] = before
            right[v] = path
            path, v = v, up[v]
        last[path] = now
        return segments


def runs_of(words: list[int], exponent: int, least: int) -> list[Run]:
    """Runs within the words that repeat their smallest period ``exponent`` times or more over ``least`` words or more."""
    automaton, ends = LastOccurrences(), {}
    for at, word in enumerate(words, 1):
        for distance, length in automaton.append(word):
            if length >= (exponent - 1) * distance and length + distance >= least:
                ends[at - length - distance, distance] = at
    return [Run(start, end - start, period) for (start, period), end in ends.items()]


def window_of(exponent: int, least: int) -> int:
    """The longest windows, `WINDOW` words at most, of which every run has one after its first period."""
    return min(WINDOW, *(max(least, exponent * q) - q for q in range(1, WINDOW + 1)))


def stretches(words: np.ndarray, owners: np.ndarray, exponent: int, least: int) -> list[tuple[int, int]]:
    """Ranges of positions that hold all runs, apart from each other and each within one owner's words."""
    window = window_of(exponent, least)
    count = len(words) - window + 1
    if count < 1:
        return []
    keys = owners[:count].astype(np.uint64)
    for j in range(window):
        keys = mix(keys * _STEP + words[j : j + count].astype(np.uint64))
    # Hash and position in one number: equal windows stand next to each other, in order.  Windows that only seem equal do no harm.
    bits = np.uint64(int(count).bit_length())
    keys = np.sort((keys >> bits << bits) | np.arange(count, dtype=np.uint64))
    places = (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    again = np.flatnonzero(keys[1:] >> bits == keys[:-1] >> bits)
    at, back = places[again + 1], places[again + 1] - places[again]
    order = np.argsort(at)
    at, back = at[order], back[order]
    within = owners[at] == owners[at + window - 1]
    at, back = at[within], back[within]
    while len(at):
        breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(owners[at]) != 0)) + 1
        lengths = np.diff(np.concatenate(([0], breaks, [len(at)])))
        longest = (lengths + window - 1) // (exponent - 1)
        held = back <= np.repeat(longest, lengths)
        if held.all():
            break
        at, back = at[held], back[held]
    else:
        return []
    firsts = np.concatenate(([0], breaks))
    out: list[tuple[int, int]] = []
    for first, length, period in zip(firsts.tolist(), lengths.tolist(), longest.tolist(), strict=True):
        owner = owners[at[first]]
        low = max(int(at[first]) - period, int(np.searchsorted(owners, owner)))
        high = int(at[first]) + length + window - 1
        if out and low <= out[-1][1] and owners[out[-1][0]] == owner:
            out[-1] = (min(low, out[-1][0]), max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _extended(words: np.ndarray, run: Run, low: int, high: int) -> Run:
    """The run as far as it goes within ``low`` to ``high``."""
    start, end, period = run.start, run.start + run.length, run.period
    while start > low and words[start - 1] == words[start - 1 + period]:
        start -= 1
    while end < high and words[end] == words[end - period]:
        end += 1
    return Run(start, end - start, period)


def find(texts: list[list[bytes]], exponent: int, least: int) -> list[list[Run]]:
    """The runs of each list of words, by start and period."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    total = int(sizes.sum())
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), dtype=np.int64, count=total)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    owners = np.repeat(np.arange(len(texts)), sizes)
    found: list[set[Run]] = [set() for _ in texts]
    for low, high in stretches(words, owners, exponent, least):
        owner = int(owners[low])
        first, end = int(starts[owner]), int(starts[owner + 1])
        for run in runs_of(words[low:high].tolist(), exponent, least):
            run = _extended(words, run._replace(start=run.start + low), first, end)
            found[owner].add(run._replace(start=run.start - first))
    return [sorted(runs, key=lambda r: (r.start, r.period)) for runs in found]


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words but for those that some run holds after its first period."""
    if runs:
        kept = np.ones(len(words), dtype=bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` and ``collapsed`` text of every row.

    Words are what stands between blanks, tabs and line ends.  A run repeats its smallest period ``exponent`` times or more (2 at
    least), over ``least`` words or more, and can't be made longer.
    """
    if exponent < 2:
        raise ValueError("a run repeats its period twice at least")

    def searched(batches):
        for batch in batches:
            names, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for a, b in slices(texts):
                words = [text.split() for text in texts[a:b]]
                runs = find(words, exponent, least)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": names.slice(a, b - a),
                        "n_words": pa.array([len(w) for w in words], pa.int64()),
                        "runs": pa.array([[r._asdict() for r in found] for found in runs], _RUNS),
                        "collapsed": pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()),
                    }
                )

    wanted = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    return wanted.mapInArrow(searched, SCHEMA).withColumn("collapsed", F.col("collapsed").cast("string"))
