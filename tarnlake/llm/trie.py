"""The prefix trie of all conversations: one node for each distinct sequence of first turns.

* A turn is digested where it is read.  The turns of a conversation, in order, give the digests of its prefixes, each made from the one before:
  equal digests are equal prefixes.  This path is a conversation's key; conversations with the same path are one entry, with
  their number, least id and a digest of all ids.
* Entries are put in the order of their paths, a preorder of the trie, by a range partitioning, so a prefix that very many
  conversations share is split over shards.  Each shard writes its part of the trie as balanced parentheses: a
  path closes what it doesn't share with the one before it and opens the rest.  Finding the closing parenthesis, by blocks of least and
  greatest excess, delimits a subtree; the rank of leaf pairs counts its leaves; sums along the preorder give members and savings.
* The nodes on a shard's first and last path, its spines, may lie in other shards too.  A shard knows the path before its first one,
  so it knows which of its nodes are not new, and counts characters, children and leaves of each node in one shard only.  All figures of
  spine nodes then add up over shards.

Entries are rows of 16 bytes a turn: texts don't move, and a conversation of 100 million turns is about the most that fits in a row.  A
shard holds its entries in memory, `SHARD_TURNS` turns on average.

Defined cases: a null role or text is empty; a null ``turn`` comes first; turns that tie come in the order of their digests; repeated rows are
turns of their own; texts of any length count whole; rows without ``conv_id`` belong to no conversation and are left out; an empty table gives no
rows, not even a root.  Further columns are not carried, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.components import stored
from tarnlake.llm.parentheses import Parentheses
from tarnlake.session import work_folder

DIGEST_BYTES = 16
#: Turns of one shard, on average, and ids of equal conversations joined by one task.
SHARD_TURNS = 200_000
IDS_PER_CHUNK = 20_000
#: What the root is called.
ROOT = b""
_NO_CONVERSATION = np.iinfo(np.int64).max


def turn_digest(role: Column, text: Column) -> Column:
    """A digest that only equal roles and texts share: the first bytes of a SHA-256."""
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * DIGEST_BYTES))


def digest_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``digest`` of role and text, and ``chars`` of the text, of all rows with a ``conv_id``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        turn_digest(role, text).alias("digest"),
        F.char_length(text).alias("chars"),
    )


def _groups(batches, key: str):
    """(value, rows) for each run of equal values in sorted batches; a run over several batches comes in parts."""
    for batch in batches:
        values = batch.column(key).to_pylist()
        starts = [i for i in range(len(values)) if i == 0 or values[i] != values[i - 1]]
        for a, b in zip(starts, [*starts[1:], len(values)], strict=True):
            yield values[a], batch.slice(a, b - a)


def _whole_groups(batches, key: str):
    """(value, parts) for each run of equal values."""
    for value, parts in itertools.groupby(_groups(batches, key), key=lambda g: g[0]):
        yield value, (rows for _, rows in parts)


def _in_batches(rows, schema: pa.Schema, weight, most: int = 100_000):
    """Record batches of rows, each of a bounded weight or of one row."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += weight(row)
        if total >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_PATHS = pa.schema([("conv_id", pa.int64()), ("path", pa.list_(pa.binary())), ("chars", pa.list_(pa.int32()))])


def _paths(batches):
    """Turns sorted by conversation, each after a row without a digest, to the digests of all its prefixes."""

    def rows():
        for conv_id, parts in _whole_groups(batches, "conv_id"):
            path, chars, last = [], [], ROOT
            for part in parts:
                for digest, n in zip(part.column("digest").to_pylist(), part.column("chars").to_pylist(), strict=True):
                    if digest is not None:
                        last = hashlib.blake2b(last + digest, digest_size=DIGEST_BYTES).digest()
                        path.append(last)
                        chars.append(n)
            yield {"conv_id": conv_id, "path": path, "chars": chars}

    yield from _in_batches(rows(), _PATHS, lambda r: 1 + len(r["path"]))


_CHUNKS = pa.schema([("end", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def _chunks(batches):
    """Rows sorted by end and id to joined ids, some thousands in a row."""

    def rows():
        for end, part in _groups(batches, "end"):
            ids = part.column("conv_id").to_pylist()
            for some in (ids[i : i + IDS_PER_CHUNK] for i in range(0, len(ids), IDS_PER_CHUNK)):
                yield {"end": end, "first": some[0], "n": len(some), "ids": ",".join(map(str, some)).encode()}

    yield from _in_batches(rows(), _CHUNKS, lambda r: r["n"])


_ENDS = pa.schema([("end", pa.binary()), ("conv_id", pa.int64()), ("n_ends", pa.int64()), ("ends_sha256", pa.string())])


def _ends(batches):
    """Chunks sorted by end and first id to one row for each end."""

    def rows():
        for end, parts in _whole_groups(batches, "end"):
            digest, count, first = hashlib.sha256(), 0, None
            for part in parts:
                for chunk in part.to_pylist():
                    digest.update(chunk["ids"] if first is None else b"," + chunk["ids"])
                    count += chunk["n"]
                    first = chunk["first"] if first is None else first
            yield {"end": end, "conv_id": first, "n_ends": count, "ends_sha256": digest.hexdigest()}

    yield from _in_batches(rows(), _ENDS, lambda r: 1)


def shared_depth(a: list[bytes], b: list[bytes]) -> int:
    """How many first digests two paths share; a digest stands for all before it."""
    return bisect.bisect_left(range(min(len(a), len(b))), True, key=lambda d: a[d] != b[d])


_NODES = pa.schema(
    [
        ("node", pa.binary()),
        ("parent", pa.binary()),
        ("spine", pa.bool_()),
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("ends_sha256", pa.string()),
    ]
)


def encode_shard(entries: list[dict], before: list[bytes] | None) -> dict:
    """Columns of `_NODES` for the distinct paths of a shard, in order; ``before`` is the path before them, if any.

    Nodes on the first path that ``before`` shares, and those on the last path, are spines: their figures are this shard's share.
    """
    known = -1 if before is None else shared_depth(before, entries[0]["path"])
    opening, names, parents, depths, chars = [True], [ROOT], [-1], [0], [0]
    ended, firsts, digests = [0], [_NO_CONVERSATION], [None]
    line = [0]  # the nodes of the path so far
    previous: list[bytes] = []
    for entry in entries:
        path = entry["path"]
        shared = shared_depth(previous, path)
        opening += [False] * (len(previous) - shared) + [True] * (len(path) - shared)
        del line[shared + 1 :]
        for depth in range(shared, len(path)):
            parents.append(line[-1])
            line.append(len(names))
            names.append(path[depth])
            depths.append(depth + 1)
            chars.append(entry["chars"][depth])
            ended.append(0)
            firsts.append(_NO_CONVERSATION)
            digests.append(None)
        at = line[-1]
        ended[at], firsts[at], digests[at] = entry["n_ends"], entry["conv_id"], entry["ends_sha256"]
        previous = path
    opening += [False] * (len(previous) + 1)

    count = len(names)
    depth, parent, size = np.array(depths), np.array(parents), np.array(chars, dtype=np.int64)
    left = np.arange(count) <= known  # the first path's nodes come first
    right = np.zeros(count, dtype=bool)
    right[line] = True
    tree = Parentheses(np.array(opening, dtype=bool))
    opens = np.flatnonzero(tree.opening)
    closes = np.fromiter(map(tree.find_close, opens.tolist()), dtype=np.int64, count=count)
    low, high = np.arange(count), tree.opened[closes]

    def subtree_sums(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[high] - sums[low]

    members = subtree_sums(np.array(ended, dtype=np.int64))
    leaves = tree.leaves[closes] - tree.leaves[opens]
    if before is not None and known == len(before):
        leaves[left] -= 1  # what the shard before took for a leaf goes on here
    children = np.bincount(parent[~left & (parent >= 0)], minlength=count)
    least = firsts
    for node in range(count - 1, 0, -1):
        above = parents[node]
        if least[node] < least[above]:
            least[above] = least[node]
    first = np.array(least, dtype=np.int64)
    spine = left | right
    above_spine = np.concatenate(([True], spine[parent[1:]]))
    return {
        "node": names,
        "parent": [None, *(names[p] for p in parents[1:])],
        "spine": spine,
        "conv_id": first,
        "depth": depth,
        "parent_conv_id": pa.array(first[parent], pa.int64(), mask=above_spine),
        "n_convs": members,
        "n_children": children,
        "n_leaves": leaves,
        "saved_tokens": subtree_sums(members * size - np.where(left, 0, size)),
        "ends_sha256": digests,
    }


def _nodes(batches):
    """Entries sorted by shard and path, after the path before the shard, to the shard's nodes."""
    for _, parts in _whole_groups(batches, "shard"):
        rows = [row for part in parts for row in part.to_pylist()]
        before = rows.pop(0)["path"] if rows[0]["n_ends"] is None else None
        columns = encode_shard(rows, before)
        whole = pa.RecordBatch.from_pydict(columns, schema=_NODES)
        for at in range(0, whole.num_rows, 10_000):
            yield whole.slice(at, 10_000)


def _ddl(schema: pa.Schema) -> str:
    kinds = {"int64": "bigint", "int32": "int", "list<item: binary>": "array<binary>", "list<item: int32>": "array<int>", "bool": "boolean"}
    return ", ".join(f"`{f.name}` {kinds.get(str(f.type), str(f.type))}" for f in schema)


def _entries(turns: DataFrame, members: DataFrame | None, folder: str) -> DataFrame:
    """One row for each distinct path, with the number, least id and digest of the conversations that have it."""
    marks = turns if members is None else turns.select("conv_id").unionByName(members.select(F.col("conv_id").cast("bigint")))
    marks = marks.where("conv_id is not null").select("conv_id").distinct()
    nothing = {"turn": F.lit(None).cast("bigint"), "digest": F.lit(None).cast("binary"), "chars": F.lit(0)}
    rows = turns.select("conv_id", F.lit(1).alias("after"), "turn", "digest", "chars").unionByName(
        marks.withColumns({"after": F.lit(0), **nothing})
    )
    in_order = rows.repartition("conv_id").sortWithinPartitions("conv_id", "after", "turn", "digest").drop("after", "turn")
    paths = stored(in_order.mapInArrow(_paths, _ddl(_PATHS)), f"{folder}/paths")
    end = F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(ROOT))
    by_end = paths.select(end.alias("end"), "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")
    chunks = by_end.mapInArrow(_chunks, _ddl(_CHUNKS)).repartition("end").sortWithinPartitions("end", "first")
    ends = stored(chunks.mapInArrow(_ends, _ddl(_ENDS)), f"{folder}/ends")
    return paths.join(ends.drop("end"), "conv_id")


def prefix_trie(turns: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """One row for each node: ``conv_id`` (its least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``.

    ``turns`` is what `digest_turns` gives; ``members`` names conversations that may have no turns.
    """
    spark = turns.sparkSession
    folder = work_folder(spark)
    entries = stored(_entries(turns, members, folder), f"{folder}/entries")
    count, size = entries.agg(F.count("*"), F.coalesce(F.sum(F.size("path")), F.lit(0))).first()
    shards = max(1, min(count // 1000, max(spark.sparkContext.defaultParallelism, size // SHARD_TURNS)))
    in_order = entries.repartitionByRange(shards, "path").sortWithinPartitions("path").withColumn("shard", F.spark_partition_id())
    in_order = stored(in_order, f"{folder}/ordered")
    # One row per shard: the only step that a single task makes.
    before = F.lag("path").over(Window.orderBy("shard"))
    lasts = in_order.groupBy("shard").agg(F.max("path").alias("path")).select("shard", before.alias("path")).where("path is not null")
    rows = in_order.unionByName(lasts, allowMissingColumns=True)
    rows = rows.repartition("shard").sortWithinPartitions("shard", "path")
    nodes = stored(rows.mapInArrow(_nodes, _ddl(_NODES)), f"{folder}/nodes")
    spines = (
        nodes.where("spine")
        .groupBy("node", "parent", "depth")
        .agg(
            F.min("conv_id").alias("conv_id"),
            *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
            F.max("ends_sha256").alias("ends_sha256"),
        )
    )
    spines = stored(spines, f"{folder}/spines")
    inner = nodes.where("not spine")
    below = inner.where("parent_conv_id is null").drop("spine", "parent_conv_id").unionByName(spines)
    named = below.join(spines.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    none = F.sha2(F.lit(b""), 256)
    return (
        inner.where("parent_conv_id is not null")
        .select(*columns, "ends_sha256")
        .unionByName(named.select(*columns, "ends_sha256"))
        .withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    )
