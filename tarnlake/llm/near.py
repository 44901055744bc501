"""Near duplicates by MinHash: fast similarity sketches, banding, and verification on whole shingle sets.

* A document's sketch has a fixed number of coordinates, filled in rounds.  In a round each shingle is hashed to one coordinate
  and competes there with its hash value; a value of an earlier round wins.  Rounds end when every coordinate is filled.  After as
  many rounds as there are coordinates, round ``t + i`` throws all shingles into coordinate ``i``, so that all fill, of small
  sets too.  Two sketches agree in a coordinate with the probability of the sets' Jaccard similarity, concentrated as with
  independent permutations, at a cost near n + t log t in place of n * t.
* Coordinates are banded.  The rows of a band follow from the threshold, so that a pair at the threshold shares no band with a
  probability of `MISS` at most.
* Documents with the same set are one node.  Nodes that share a band are joined into candidate groups.  In a group of one block every pair
  is compared exactly, not only those that share a band, as a product of incidence matrices.
* In a larger group each node is first compared with one leader, of a band that it shares with most: rows grow with the nodes, and the leader
  travels to blocks of them.  Verified links are contracted, and bands whose nodes are in one component by now are done.  What is left
  falls into new groups, which are dealt over blocks, large components over blocks of their own.  Each pair of blocks, but for two of one
  component, is compared by one task.  A task returns a spanning forest of its links and no pairs, so rows grow with the documents.  Links are
  closed into components.

A family of near copies is so contracted in time that grows with its size.  Work that grows with the square is left only for very many texts that share
bands, and so are about half alike or more, without being linked; it is spread over tasks.  Copies of one text cost nothing.

Defined cases: a null or empty text has no shingles and no link; rows that share a ``doc_id`` are one document, linked as any of their
texts; a row without ``doc_id`` has component null and is kept; an empty table gives no rows; further columns are
carried by `drop_near_duplicates` and not by `near_components`, whatever their names; a text of any length is read whole, as one row.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.components import connected, stored
from tarnlake.llm.encoding import slices
from tarnlake.llm.shingles import mix, shingle_set
from tarnlake.session import work_folder

#: Coordinates of a sketch, and the probability of missing a pair at the threshold that sets the rows of a band.
COORDINATES = 120
MISS = 1e-6
#: Whether the nodes of large groups are compared with leaders first.
LEADERS = True
#: Steps from a node to its leader, to that one's, and so on.
STEPS = 3
#: Documents of a block, and shingles that count as one document.
BLOCK_DOCUMENTS = 256
SHINGLES_PER_DOCUMENT = 8192
#: Columns of the incidence matrices multiplied at once.
COLUMNS = 16_384
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_VALUE_BITS = np.uint64(40)


def band_rows(percent: int) -> int:
    """The longest bands that miss a pair at the threshold with a probability of `MISS` at most."""
    miss = lambda r: (1 - (percent / 100) ** r) ** (COORDINATES // r)
    return max((r for r in range(1, 13) if miss(r) <= MISS), default=1)


def sketch(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """One row of t coordinates for each set, none of them empty."""
    out = np.full((len(sets), t), _EMPTY, dtype=np.uint64)
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    elements = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owners = np.repeat(np.arange(len(sets)), lengths)
    flat = out.reshape(-1)
    low = (np.uint64(1) << _VALUE_BITS) - np.uint64(1)
    for turn in range(2 * t):
        hashed = mix(elements + np.uint64((turn + 1) * 0xD6E8FEB86659FD93 % 2**64))
        if turn < t:
            place = ((hashed >> _VALUE_BITS) * np.uint64(t)) >> np.uint64(24)
        else:
            place = np.full(len(hashed), turn - t, dtype=np.uint64)
        value = (hashed & low) | (np.uint64(turn) << _VALUE_BITS)
        np.minimum.at(flat, owners * t + place.astype(np.int64), value)
        open_sets = (out == _EMPTY).any(axis=1)
        if not open_sets.any():
            break
        still = open_sets[owners]
        elements, owners = elements[still], owners[still]
    return out


def bands(sketches: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each run of ``rows`` coordinates, different for different bands."""
    count = sketches.shape[1] // rows
    out = np.tile(np.arange(count, dtype=np.uint64), (len(sketches), 1))
    for j in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + sketches[:, j : count * rows : rows])
    return out.view(np.int64)


def _sketched(size: int, rows: int):
    def run(batches):
        for batch in batches:
            names, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for a, b in slices(texts):
                sets = [shingle_set(text, size) for text in texts[a:b]]
                full = [i for i, s in enumerate(sets) if len(s)]
                banded: list = [None] * len(sets)
                for i, values in zip(full, bands(sketch([sets[i] for i in full]), rows), strict=True):
                    banded[i] = values
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": names.slice(a, b - a),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "digest": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        "bands": pa.array(banded, pa.list_(pa.int64())),
                    }
                )

    return run


def links(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> np.ndarray:
    """For each set the first one that it is connected to, by similarities between different sides, or within the only side."""
    count = len(sets)
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    owners = np.repeat(np.arange(count), lengths)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owners, column = owners[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owners, column = owners[order], np.cumsum(np.diff(column[order], prepend=column[order][:1]) > 0)
    common = np.zeros((count, count), dtype=np.int64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        held = np.zeros((count, min(COLUMNS, int(column[-1]) + 1 - first)), dtype=np.float32)
        held[owners[a:b], column[a:b] - first] = 1
        common += (held @ held.T).astype(np.int64)
    union = lengths[:, None] + lengths[None, :] - common
    linked = (100 * common >= percent * union) & (union > 0)
    if len(np.unique(sides)) > 1:
        linked &= sides[:, None] != sides[None, :]
    np.fill_diagonal(linked, True)
    label = np.arange(count)
    while True:
        least = np.where(linked, label[None, :], count).min(axis=1)
        if (least == label).all():
            return label
        label = least


def _compared(size: int, percent: int):
    """Batches sorted by unit to the links within each unit."""

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("candidates", "low", "high", "block", "node", "text")), strict=True)

    def run(batches):
        found: list[tuple[int, int]] = []
        for _, unit in itertools.groupby(rows(batches), key=lambda r: r[:3]):
            unit = list(unit)
            if len(unit) > 1:
                label = links([shingle_set(r[5], size) for r in unit], np.array([r[3] for r in unit]), percent)
                found += [(unit[i][4], unit[k][4]) for i, k in enumerate(label.tolist()) if i != k]
            if len(found) > 10_000:
                yield _edges(found)
                found = []
        yield _edges(found)

    return run


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _nodes(spark, docs: DataFrame, size: int, percent: int, folder: str) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``digest`` of all rows, with ``bands``, written once."""
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    schema = "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"
    texts.mapInArrow(_sketched(size, band_rows(percent)), schema).write.parquet(f"{folder}/sketches")
    return spark.read.schema(schema).parquet(f"{folder}/sketches")


def near_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Documents whose sets of ``size``-word shingles have a Jaccard similarity of ``percent`` hundredths or more are linked;
    ``component_id`` is the smallest ``doc_id`` that links lead to.
    """
    spark = docs.sparkSession
    folder = work_folder(spark)
    sketches = _nodes(spark, docs, size, percent, folder)
    named = sketches.where("digest is not null and doc_id is not null")
    # One node for each set, named by its smallest document; a document of several texts is one node of several sets.
    members = stored(named.groupBy("digest").agg(F.min("doc_id").alias("node")), f"{folder}/members")
    banded = (
        named.join(members, (named["digest"] == members["digest"]) & (named["doc_id"] == members["node"]), "left_semi")
        .select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
        .distinct()
    )
    banded = stored(banded, f"{folder}/bands")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("binary").alias("text")).where(
        "text is not null"
    )
    links_found = _all_links(texts, banded, size, percent, folder)
    # Copies hang on their node.  A document of several texts hangs on, or is, the nodes of all of them.
    copies = named.join(members, "digest").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    closed = connected(links_found.unionByName(copies))
    closed = closed.select(F.col("node").alias("doc_id"), F.col("component").alias("found"))
    component = F.coalesce("found", "doc_id")
    return sketches.join(closed, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _all_links(texts: DataFrame, banded: DataFrame, size: int, percent: int, folder: str) -> DataFrame:
    """Links that connect all nodes which similar pairs that share bands connect."""
    groups = _groups(banded, f"{folder}/groups")
    large = groups.where(F.col("blocks") > 1)
    # All texts cross the network here, once; from then on only those of large groups do.
    held = texts.join(groups.hint("shuffle_hash"), "node")
    if not LEADERS or large.first() is None:
        return _compared_blocks(_dealt(held), size, percent, f"{folder}/blocks")
    held = stored(held, f"{folder}/held")
    found = _compared_blocks(_dealt(held.where("blocks = 1")), size, percent, f"{folder}/blocks")
    texts = held.where("blocks > 1").select("node", "text")
    banded = stored(banded.join(large.select("node").hint("shuffle_hash"), "node", "left_semi"), f"{folder}/large")
    led = _compared_to_leaders(texts, _leaders(banded, percent, folder), size, percent, folder)
    found = found.unionByName(led)
    # Nodes of one component are one from now on, and bands that hold only one are done.
    inside = led.distinct().groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    for _ in range(STEPS):
        further = inside.select(F.col("node").alias("component"), F.col("component").alias("next"))
        inside = inside.join(further, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    labelled = banded.join(inside, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = stored(labelled, f"{folder}/labelled")
    mixed = labelled.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    left = labelled.join(stored(mixed.select("band"), f"{folder}/mixed"), "band", "left_semi")
    left = stored(left, f"{folder}/left")
    if left.first() is None:
        return found
    components = left.select("node", "component").distinct()
    dealt = _dealt_by_component(_groups(left, f"{folder}/rest").join(components, "node"), left, f"{folder}/rest")
    rest = texts.join(dealt.hint("shuffle_hash"), "node")
    return found.unionByName(_compared_blocks(rest, size, percent, f"{folder}/rest/blocks"))


def _dealt(held: DataFrame) -> DataFrame:
    """Rows of `_groups` with the ``block`` of each node, to be compared with all ``others``."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return held.withColumns({"block": block, "others": F.sequence(F.lit(0), F.col("blocks") - 1)})


def _dealt_by_component(groups: DataFrame, banded: DataFrame, path: str) -> DataFrame:
    """As `_dealt`, with blocks of their own for components larger than a block, which aren't compared with each other."""
    sizes = banded.groupBy("node").agg(F.max(_weight(F.col("n"))).alias("weight"))
    parts = groups.join(sizes, "node").groupBy("candidates", "component").agg(F.sum("weight").alias("weight"))
    own = F.when(F.col("weight") > BLOCK_DOCUMENTS, F.ceil(F.col("weight") / BLOCK_DOCUMENTS)).otherwise(0).cast("int").alias("own")
    parts = stored(parts.select("candidates", "component", "weight", own), f"{path}/parts")
    # Components that fill a block, one row each, after the blocks that all others share.
    pooled = parts.groupBy("candidates").agg(
        F.ceil(F.coalesce(F.sum(F.when(F.col("own") == 0, F.col("weight"))), F.lit(0)) / BLOCK_DOCUMENTS).cast("int").alias("pooled"),
        F.sum("own").cast("int").alias("owned"),
    )
    before = Window.partitionBy("candidates").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("own").over(before), F.lit(0)).cast("int").alias("before")
    placed = parts.where("own > 0").select("candidates", "component", "own", first)
    rows = groups.drop("blocks").join(stored(pooled, f"{path}/pooled"), "candidates")
    rows = rows.join(stored(placed, f"{path}/placed"), ["candidates", "component"], "left")
    low = F.col("pooled") + F.col("before")
    every = F.sequence(F.lit(0), F.col("pooled") + F.col("owned") - 1)
    block = F.when(F.col("own").isNull(), F.pmod(F.xxhash64("node"), F.col("pooled"))).otherwise(low + F.pmod(F.xxhash64("node"), F.col("own")))
    others = F.when(F.col("own").isNull(), every).otherwise(F.filter(every, lambda o: (o < low) | (o >= low + F.col("own"))))
    return rows.select("node", "candidates", block.cast("int").alias("block"), others.alias("others"))


def _weight(n: Column) -> Column:
    """As how many documents a set of ``n`` shingles counts."""
    return F.ceil(n / SHINGLES_PER_DOCUMENT)


def _groups(banded: DataFrame, path: str) -> DataFrame:
    """``node``, ``candidates`` (its group) and ``blocks`` (of that group) of all nodes that share a band with another."""
    leaders = banded.groupBy("band").agg(F.min("node").alias("b"), F.count("*").alias("m")).where("m > 1").drop("m")
    leaders = stored(leaders, f"{path}/first")
    neighbours = banded.join(leaders, "band").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    groups = connected(neighbours)
    firsts = groups.select(F.col("component").alias("node"), "component").distinct()
    groups = stored(groups.unionByName(firsts).select("node", F.col("component").alias("candidates")), f"{path}/groups")
    sizes = banded.groupBy("node").agg(F.max(_weight(F.col("n"))).alias("weight"))
    weights = groups.join(sizes, "node").groupBy("candidates").agg(F.sum("weight").alias("weight"))
    blocks = F.ceil(F.col("weight") / BLOCK_DOCUMENTS).cast("int")
    weights = stored(weights.select("candidates", blocks.alias("blocks")), f"{path}/weights")
    return groups.join(weights, "candidates")


def _leaders(banded: DataFrame, percent: int, path: str) -> DataFrame:
    """``node`` and ``leader``: for each node the leader of most of its bands that is near enough in size to be similar.

    A band's leader is drawn by a hash, which favours the same node in all bands of a family.
    """
    drawn = F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("leader"), F.col("n").alias("size")))
    leaders = stored(banded.groupBy("band").agg(drawn.alias("l")).select("band", "l.leader", "l.size"), f"{path}/drawn")
    near = F.lit(100) * F.least("n", "size") >= F.lit(percent) * F.greatest("n", "size")
    shared = banded.join(leaders, "band").where((F.col("node") != F.col("leader")) & near)
    shared = shared.groupBy("node", "leader").count()
    best = F.max(F.struct(F.col("count"), (-F.col("leader")).alias("l"))).alias("best")
    return stored(shared.groupBy("node").agg(best).select("node", (-F.col("best.l")).alias("leader")), f"{path}/best")


def _compared_to_leaders(texts: DataFrame, pairs: DataFrame, size: int, percent: int, path: str) -> DataFrame:
    """Links of nodes with their leaders, whose texts go to blocks of the nodes."""
    counts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK_DOCUMENTS).cast("int").alias("blocks"))
    counts = stored(counts, f"{path}/counts")
    dealt = pairs.join(counts, "leader").select(
        "leader", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node", F.lit(1).alias("follows")
    )
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    leading = counts.select("leader", blocks).withColumns({"node": F.col("leader"), "follows": F.lit(0)})
    rows = texts.join(dealt.unionByName(leading).hint("shuffle_hash"), "node")
    rows = rows.repartition("leader", "block").sortWithinPartitions("leader", "block", "follows")
    rows.select("leader", "block", "follows", "node", "text").mapInArrow(_linked(size, percent), "a bigint, b bigint").write.parquet(
        f"{path}/links"
    )
    return texts.sparkSession.read.schema("a bigint, b bigint").parquet(f"{path}/links")


def _linked(size: int, percent: int):
    """Batches sorted by unit, each led by its leader's rows, to the links with it."""

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("leader", "block", "follows", "node", "text")), strict=True)

    def run(batches):
        found: list[tuple[int, int]] = []
        for (leader, _), unit in itertools.groupby(rows(batches), key=lambda r: r[:2]):
            leading = []
            for _, _, follows, node, text in unit:
                own = shingle_set(text, size)
                if not follows:
                    leading.append(own)  # a document of several texts has several rows
                elif any(similar(own, other, percent) for other in leading):
                    found.append((node, leader))
            if len(found) > 10_000:
                yield _edges(found)
                found = []
        yield _edges(found)

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common) > 0


def _compared_blocks(held: DataFrame, size: int, percent: int, path: str) -> DataFrame:
    """Links between the nodes of each group, dealt to blocks with their texts, as a spanning forest of every unit of blocks."""
    units = held.select("candidates", "block", F.explode("others").alias("other"), "node", "text").select(
        "candidates",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "block",
        "node",
        "text",
    )
    key = ["candidates", "low", "high"]
    sorted_units = units.repartition(*key).sortWithinPartitions(*key)
    sorted_units.mapInArrow(_compared(size, percent), "a bigint, b bigint").write.parquet(path)
    return held.sparkSession.read.schema("a bigint, b bigint").parquet(path)


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are linked to one of a smaller ``doc_id``."""
    dropped = near_components(docs, size, percent).where("not kept").select("doc_id").distinct().alias("dropped")
    same = F.col("kept_or_not.doc_id").cast("bigint") == F.col("dropped.doc_id")
    return docs.alias("kept_or_not").join(dropped.hint("shuffle_hash"), same, "left_anti")
