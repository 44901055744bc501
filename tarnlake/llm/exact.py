"""Exact duplicates by distributed MSD radix partitioning.

Texts are equal when they are the same after deleting blanks, tabs, line feeds, vertical tabs, form feeds and
carriage returns.  All documents start in one group.  Each round looks at the next bytes of the stripped texts of a group, a digit
of fixed width, and splits the group by it, texts that end within the digit apart from those that go on.  A group of one
is done, as is a group whose texts have ended: these are equal, byte for byte, and no digest was compared.  Digits widen from
round to round, so a long text takes few rounds, and most texts leave after the first.

A round counts the groups' digits with partial sums before the shuffle and writes the counts of groups of several, one row a
group.  Rows are joined with what is written rather than with the aggregate, since adaptive execution splits a group with
very many copies over tasks only between two plain shuffles.  Each round is written to the shared work folder, too, which
cuts the lineage and is all that a lost executor can cost.

Of equal texts the row with the most code points stays, then the one with the smallest ``doc_id`` (null last), then the first
as read.  Defined cases: a null text is empty, and empty texts are equal; a null ``doc_id`` is an id like any other;
repeated rows are copies of which one stays; an empty table gives no rows; columns named like an added one
(``keep_id group_size kept``) are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.session import work_folder

#: What is deleted before texts are compared.
BLANKS = " \t\n\x0b\x0c\r"
FIRST_WIDTH = 256
WIDENING = 8
ADDED = ("keep_id", "group_size", "kept")


def strip(text: Column) -> Column:
    """The text without blanks, empty for null."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return F.coalesce(text, F.lit(""))


def radix_groups(docs: DataFrame, carry: Sequence[str] | None = None) -> DataFrame:
    """One row per document: the ``row`` of its carried columns, ``doc_id``, ``chars``, ``seen`` (a number of its own), ``head`` and ``size`` of its group.

    Equal texts have the same ``head``.  By default all columns are carried.
    """
    spark = docs.sparkSession
    carry = list(docs.columns if carry is None else carry)
    with_text = "text" in carry
    rows = docs.select(
        F.struct(*[docs[c] for c in carry], F.lit(0).alias("_")).alias("row"),
        docs["doc_id"].alias("doc_id"),
        F.char_length(F.coalesce(docs["text"], F.lit(""))).alias("chars"),
        F.monotonically_increasing_id().alias("seen"),
        *([] if with_text else [docs["text"].alias("body")]),
        F.lit(0).cast("bigint").alias("head"),
    )
    body = F.col("row.text") if with_text else F.col("body")
    folder, level, offset, width = work_folder(spark), 0, 0, FIRST_WIDTH
    done = None
    while True:
        stripped = strip(body).cast("binary")
        split = rows.withColumns(
            {"digit": F.substring(stripped, offset + 1, width), "ended": F.octet_length(stripped) <= offset + width}
        )
        counts = split.groupBy("head", "digit", "ended").agg(F.count("*").alias("size"), F.min("seen").alias("next"))
        counts.where("size > 1").write.parquet(f"{folder}/counts={level}")
        several = spark.read.schema(counts.schema).parquet(f"{folder}/counts={level}")
        final = F.col("ended") | F.col("size").isNull()
        joined = split.join(several.hint("shuffle_hash"), ["head", "digit", "ended"], "left").select(
            "row",
            "doc_id",
            "chars",
            "seen",
            *([] if with_text else [F.when(~final, F.col("body")).alias("body")]),
            F.coalesce("next", "seen").alias("head"),
            F.coalesce("size", F.lit(1)).alias("size"),
            final.alias("final"),
        )
        path = f"{folder}/level={level}"
        joined.write.parquet(path)
        written = spark.read.schema(joined.schema).parquet(path)
        ready = written.where("final").select("row", "doc_id", "chars", "seen", "head", "size")
        done = ready if done is None else done.unionByName(ready)
        rows = written.where("not final").drop("size", "final")
        if rows.isEmpty():
            return done
        level, offset, width = level + 1, offset + width, width * WIDENING


def _best(groups: DataFrame) -> DataFrame:
    """The row of each group of several that stays, written once."""
    order = F.struct(-F.col("chars"), F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("seen").alias("first"))
    best = groups.where("size > 1").groupBy("head").agg(F.min(order).alias("best"))
    best = best.select("head", F.col("best.id").alias("keep_id"), F.col("best.first").alias("first"))
    spark, folder = groups.sparkSession, work_folder(groups.sparkSession)
    best.write.parquet(folder)
    return spark.read.schema(best.schema).parquet(folder)


def mark_duplicates(docs: DataFrame, carry: Sequence[str] | None = None) -> DataFrame:
    """The carried columns of every row with ``keep_id``, ``group_size`` and ``kept``."""
    groups = radix_groups(docs, [c for c in (docs.columns if carry is None else carry) if c not in ADDED])
    names = [f"row.`{c}`" for c in groups.schema["row"].dataType.names if c != "_"]
    alone = groups.where("size = 1").select(
        *names, F.col("doc_id").alias("keep_id"), F.col("size").alias("group_size"), F.lit(True).alias("kept")
    )
    several = groups.where("size > 1").join(_best(groups), "head")
    return alone.unionByName(
        several.select(*names, "keep_id", F.col("size").alias("group_size"), (F.col("seen") == F.col("first")).alias("kept"))
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with the columns of ``docs``."""
    groups = radix_groups(docs)
    names = [F.col(f"row.`{c}`") for c in docs.columns]
    kept = groups.where("size > 1").join(_best(groups).select(F.col("first").alias("seen")), "seen", "left_semi")
    return groups.where("size = 1").select(*names).unionByName(kept.select(*names))
