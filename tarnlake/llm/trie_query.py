"""Query 12: the prefix trie of all conversations, rebuilt so that many of them begin alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.llm import trie
from tarnlake.llm.crc_sql import CRC_TABLE, crc32
from tarnlake.llm.registry import query, table

#: Conversations of which one lends its first turns to the others, and one more than the most turns lent.
FAMILY, HEADS = 100, 6


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns whose first ones come from the first conversation of each family, and all conversations."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    placed = turns.withColumn("turn", F.row_number().over(order).cast("bigint"))
    convs = turns.select("conv_id").distinct()
    convs = convs.withColumn("heads", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    lent = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("turn") < HEADS)).withColumnRenamed("conv_id", "base")
    heads = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(lent, "base").where("turn <= heads")
    own = placed.where(F.col("turn") > F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    columns = ["conv_id", "turn", "digest", "chars"]
    return heads.select(*columns).unionByName(own.select(*columns)), convs.select("conv_id")


@query(
    "op12_parentheses_trie",
    f"""
    WITH {CRC_TABLE}, turns AS (
        SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
            substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS digest
        FROM conversations WHERE conv_id IS NOT NULL
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM turns
    ), convs AS (
        SELECT conv_id, {crc32("conv_id")} % {HEADS} AS heads FROM (SELECT DISTINCT conv_id FROM turns), crc_table
    ), rebuilt AS (
        SELECT c.conv_id, pos, digest, chars FROM convs c JOIN placed p ON p.conv_id = c.conv_id - c.conv_id % {FAMILY} AND pos <= heads
        UNION ALL SELECT conv_id, pos, digest, chars FROM convs JOIN placed USING (conv_id) WHERE pos > heads
    ), prefixes AS (
        SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS path, chars FROM rebuilt
        WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
        UNION ALL SELECT conv_id, 0, '', 0 FROM convs
    ), nodes AS (
        SELECT path, depth, left(path, 32 * (depth - 1)) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars
        FROM prefixes GROUP BY path, depth
    ), children AS (
        SELECT parent AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent
    ), sums AS (
        SELECT p.path, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (n.path NOT IN (SELECT path FROM children)) AS n_leaves
        FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.path
    ), ends AS (
        SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
        FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS deepest FROM prefixes) WHERE depth = deepest GROUP BY path
    )
    SELECT n.conv_id, n.depth, CASE WHEN n.depth > 0 THEN p.conv_id END AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
        n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM nodes n JOIN nodes p ON p.path = CASE WHEN n.depth > 0 THEN n.parent ELSE n.path END JOIN sums s ON s.path = n.path
        LEFT JOIN children c ON c.path = n.path LEFT JOIN ends e ON e.path = n.path
    """,
)
def parentheses_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*rebuilt(trie.digest_turns(table(spark, sf_dir, "conversations"))))
