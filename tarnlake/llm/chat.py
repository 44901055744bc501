"""Chat formatting: every assistant turn becomes an example whose context is all turns before it.

A conversation is formatted once, turn by turn, and a prefix of it is named by a length: example ``k`` is the
text of its conversation up to ``context_chars``, which is not trained on, followed by the formatted target
turn, of which the span from ``loss_start`` to ``loss_end`` is.  `format_turns` places the turns and names the prefixes;
`expanded_texts` expands them to one string for each example, and `conversation_digests` reads from that expansion.

A turn reads ``<|im_start|>role``, a line break, the text, ``<|im_end|>``, a line break.  Inside roles and texts
a backslash is written ``\\s``, ``<|`` is written ``<\\|``, and in roles a line break is written ``\\n``, so
no text can contain a control string and everything can be read back.

Defined cases: a null text or role is empty; a null ``conv_id`` is a conversation of its own; turns come in the order
of ``turn`` (null first), and ties in the order of role and text; repeated rows are turns of their own; an empty
table gives no rows.  Further columns of the input are not carried.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TARGET_ROLE = "assistant"
#: Turns of one conversation whose offsets are summed by one task; sums of such blocks are summed in turn.
TURNS_PER_BLOCK = 1024


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn, an example if ``example`` is not null.

    Columns: ``conv_id``, ``block`` and ``position`` (order within the conversation), ``role``, ``formatted`` (the
    turn's text), ``context_chars`` (length of all formatted turns before it), ``example`` (number of the example
    whose target the turn is), ``loss_start`` and ``loss_end`` (its trainable span, counted from the start of
    the conversation).
    """
    body = escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    turns = conversations.select(
        "conv_id",
        F.coalesce("conv_id", F.lit(0)).alias("conv"),
        F.col("conv_id").isNull().alias("nameless"),
        F.col("turn").cast("bigint").alias("turn"),
        F.floor(F.coalesce(F.col("turn").cast("bigint"), F.lit(-1)) / TURNS_PER_BLOCK).alias("block"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.concat(head, body, F.lit(END + "\n")).alias("formatted"),
        F.char_length(head).alias("head_chars"),
    )
    turns = turns.withColumns(
        {
            "chars": F.char_length("formatted").cast("bigint"),
            "target": (F.col("role") == TARGET_ROLE).cast("bigint"),
        }
    )
    # Sums of whole blocks first, so that no task has to hold or sort a long conversation.
    block = ["conv", "nameless", "block"]
    before = Window.partitionBy("conv", "nameless").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        turns.groupBy(*block)
        .agg(F.sum("chars").alias("c"), F.sum("target").alias("t"))
        .select(
            *block,
            F.coalesce(F.sum("c").over(before), F.lit(0)).alias("block_chars"),
            F.coalesce(F.sum("t").over(before), F.lit(0)).alias("block_targets"),
        )
    )
    order = Window.partitionBy(*block).orderBy("turn", "role", "formatted")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumns(
        {
            "position": F.row_number().over(order),
            "chars_before": F.coalesce(F.sum("chars").over(earlier), F.lit(0)),
            "targets_before": F.coalesce(F.sum("target").over(earlier), F.lit(0)),
        }
    )
    context = F.col("block_chars") + F.col("chars_before")
    trained = F.col("target") == 1
    start = context + F.col("head_chars")
    return placed.join(blocks, block).select(
        "conv_id",
        "block",
        "position",
        "role",
        "formatted",
        context.alias("context_chars"),
        F.when(trained, F.col("block_targets") + F.col("targets_before")).alias("example"),
        F.when(trained, start).alias("loss_start"),
        F.when(trained, context + F.col("chars") - len(END) - 1).alias("loss_end"),
    )


def examples(turns: DataFrame) -> DataFrame:
    """The rows of `format_turns` that are examples: a context length, a target text and its trainable span."""
    return turns.where(F.col("example").isNotNull())


def trained_text(text: Column, offset: Column) -> Column:
    """What the loss of an example covers, of a text that begins ``offset`` characters into the conversation."""
    length = F.col("loss_end") - F.col("loss_start")
    return unescape(F.substring(text, (F.col("loss_start") - offset + 1).cast("int"), length.cast("int")))


def _conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: its turns in order in ``rows``, and its formatted text, which must fit in a row, in ``whole``."""
    place = ("block", "position", "formatted", "example", "context_chars", "loss_start", "loss_end")
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*place))).alias("rows"))
    return rows.withColumn("whole", F.array_join("rows.formatted", ""))


def _expand(conversations: DataFrame, *kept: str) -> DataFrame:
    """The expansion: for each example a row with its context and its target turn spelled out, and its span in both together.

    A conversation without examples keeps a row whose ``example`` is null; ``kept`` are further columns to keep.
    """
    found = F.explode_outer(F.filter("rows", lambda r: r["example"].isNotNull())).alias("e")
    each = conversations.select("conv_id", *kept, "whole", found)
    first_after = F.col("e.loss_end") + len(END) + 1

    def part(start: Column, end: Column) -> Column:
        return F.substring("whole", (start + 1).cast("int"), (end - start).cast("int"))

    return each.select(
        "conv_id",
        *kept,
        "e.example",
        part(F.lit(0), F.col("e.context_chars")).alias("context"),
        part(F.col("e.context_chars"), first_after).alias("target"),
        "e.loss_start",
        "e.loss_end",
    )


def expanded_texts(turns: DataFrame) -> DataFrame:
    """Each example with its context and target in one string: ``conv_id``, ``example``, ``text``, ``loss_start``, ``loss_end``.

    The texts of a conversation add up to its length times its number of examples; a task holds one of them at a time.
    """
    spelled = _expand(_conversations(turns)).where(F.col("example").isNotNull())
    return spelled.select("conv_id", "example", F.concat("context", "target").alias("text"), "loss_start", "loss_end")


def _read(formatted: Column) -> tuple[Column, Column]:
    """Role and text of a formatted turn."""
    markers = len(START) + len(END) + 1
    inner = F.substring(formatted, F.lit(len(START) + 1), F.char_length(formatted) - markers)
    role = F.substring_index(inner, "\n", 1)
    text = F.substring(inner, F.char_length(role) + 2, F.char_length(inner))
    return unescape_role(role), unescape(text)


def read_turns(turns: DataFrame) -> DataFrame:
    """``role`` and ``text`` of each formatted turn, read back from its text alone, beside the columns of `format_turns`."""
    role, text = _read(F.col("formatted"))
    return turns.withColumns({"role": role, "text": text})


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation with counts and digests of what its formatted turns and examples give back.

    What is trained on, ``n_examples`` and ``context_chars`` (the length of all contexts together) are read from the expanded
    examples, each with its context spelled out.  Native, but a conversation must fit in a row, and its expansion takes time
    with the square of its turns; `stream_digests` reads conversations of any length, without expansion.
    """

    def spoken(row: Column) -> Column:
        role, text = _read(row["formatted"])
        return F.concat(role, F.lit("\n"), text, F.lit("\n"))

    conversations = _conversations(turns).withColumns(
        {
            "n_turns": F.size("rows").cast("bigint"),
            "turns_sha256": F.sha2(F.array_join(F.transform("rows", spoken), "").cast("binary"), 256),
            "formatted_chars": F.char_length("whole").cast("bigint"),
        }
    )
    kept = ("n_turns", "turns_sha256", "formatted_chars")
    spelled = _expand(conversations, *kept)
    # The span is read in context and target together, as a trainer would.
    length = F.col("loss_end") - F.col("loss_start")
    trained = F.substring(F.concat("context", "target"), (F.col("loss_start") + 1).cast("int"), length.cast("int"))
    read = spelled.select(
        "conv_id", *kept, "example", unescape(trained).alias("trained"), F.char_length("context").cast("bigint").alias("context_chars")
    )
    sums = read.groupBy("conv_id", *kept).agg(
        F.array_sort(F.collect_list(F.struct("example", "trained"))).alias("examples"),
        F.count("example").alias("n_examples"),
        F.coalesce(F.sum("context_chars"), F.lit(0)).alias("context_chars"),
    )
    # The null of a conversation without examples is left out.
    text = F.array_join("examples.trained", "")
    return sums.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.char_length(text).cast("bigint").alias("loss_chars"),
        F.sha2(text.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
        "context_chars",
    )


def stream_digests(turns: DataFrame) -> DataFrame:
    """What `conversation_digests` gives, turn by turn, so that only single turns must fit in a row.

    A digest of texts in order is made by one task; a long conversation is sorted on its disk, never held.  What
    is trained on comes from the rows that are `examples`; an example whose context is not exactly the turns
    before it, or whose number is not the next, raises.
    """
    in_order = read_turns(turns.repartition("conv_id").sortWithinPartitions("conv_id", "block", "position"))
    trained = F.when(F.col("example").isNotNull(), trained_text(F.col("formatted"), F.col("context_chars")))
    trained = F.coalesce(trained, F.lit(""))
    rows = in_order.select(
        "conv_id",
        "context_chars",
        "example",
        F.concat("role", F.lit("\n"), "text", F.lit("\n")).cast("binary").alias("whole"),
        trained.cast("binary").alias("trained"),
        F.char_length(trained).cast("bigint").alias("loss_chars"),
        F.char_length("formatted").cast("bigint").alias("chars"),
    )
    kind = turns.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(
        _digested,
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )


class _Digest:
    """The sums of the conversation being read."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.turns = self.examples = self.loss_chars = self.chars = 0
        self.whole, self.trained = hashlib.sha256(), hashlib.sha256()

    def add(self, rows: pa.RecordBatch) -> None:
        for name, digest in (("whole", self.whole), ("trained", self.trained)):
            for text in rows.column(name):
                digest.update(text.as_buffer())
        self.turns += rows.num_rows
        self.loss_chars += sum(rows.column("loss_chars").to_pylist())
        for context, example, chars in zip(*(rows.column(c).to_pylist() for c in ("context_chars", "example", "chars")), strict=True):
            if context != self.chars or example not in (None, self.examples):
                raise ValueError(f"conversation {self.conv_id}: example {example} has a context of {context}, not {self.chars} characters")
            self.chars += chars
            self.examples += example is not None

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.whole.hexdigest(), self.loss_chars, self.trained.hexdigest(), self.chars


def _digested(batches):
    """Rows of conversations that come whole and in order, though not in one batch."""
    digest, kind = None, None

    def out(rows):
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        kind = batch.column("conv_id").type
        ids = batch.column("conv_id").to_pylist()
        starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
        done = []
        for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
            if digest is None or digest.conv_id != ids[a]:
                if digest is not None:
                    done.append(digest.row())
                digest = _Digest(ids[a])
            digest.add(batch.slice(a, b - a))
        if done:
            yield out(done)
    if digest is not None:
        yield out([digest.row()])
