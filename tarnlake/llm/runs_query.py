"""Query 13: periodic runs of all documents, of which a tenth have their words repeated from some word on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import runs
from tarnlake.llm.crc_sql import CRC_TABLE, crc32
from tarnlake.llm.registry import query, table

EXPONENT, LEAST = 4, 6
BLANKS = r"[\x20\x09-\x0D]+"


def repeated_words(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of all rows; where the id's CRC-32 ends in 0, the words from one on are a shorter stretch again and again.

    A null ``doc_id`` leaves the text as it is.
    """
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    chosen = hashed.withColumn("w", F.when(F.col("h") % 10 == 0, words))
    chosen = chosen.withColumns({"n": F.expr("nullif(size(w), 0)"), "g": F.expr("h div 10")})
    placed = chosen.withColumns({"a": F.expr("g % n"), "p": F.expr("1 + (n - g % n) div (3 + g % 8)")})
    repeated = F.expr("transform(w, (x, i) -> if(i < a, x, w[int(a + (i - a) % p)]))")
    return placed.select("doc_id", F.coalesce(F.when(F.col("n") > 0, F.array_join(repeated, " ")), "text").alias("text"))


def longest_runs(docs: DataFrame) -> DataFrame:
    """Per document the number of runs, the one of greatest exponent, and digests of all runs and of the collapsed text."""
    found = runs.find_runs(docs, EXPONENT, LEAST)
    # Exponents are compared exactly, as products; the first of equal ones stays, in the order of starts and periods.
    best = F.expr(
        "aggregate(runs, runs[0], (best, r) -> if(r.length * best.period > best.length * r.period, r, best))"
    )
    best = F.when(F.size("runs") > 0, best)
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query(
    "op13_automaton_runs",
    f"""
    WITH {CRC_TABLE}, split AS (
        SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{BLANKS}'), lambda x: x <> '') AS w,
            {crc32("doc_id")} AS h
        FROM documents, crc_table
    ), placed AS (
        SELECT doc_id, w, h, len(w) AS n, (h // 10) % len(w) AS a, 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) AS p
        FROM split WHERE len(w) > 0
    ), words AS (
        SELECT doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
        FROM (SELECT *, unnest(range(n)) AS i FROM placed)
    ), windows AS (
        SELECT doc_id, n, i, word || ' ' || lead(word) OVER d || ' ' || lead(word, 2) OVER d AS g FROM words
        WINDOW d AS (PARTITION BY doc_id ORDER BY i)
    ), pairs AS (
        SELECT x.doc_id, x.i, y.i - x.i AS q FROM windows x JOIN windows y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i
        WHERE {EXPONENT} * (y.i - x.i) <= x.n
    ), islands AS (
        SELECT doc_id, q, min(i) AS s, count(*) + 2 + q AS m
        FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island
    ), runs AS (
        SELECT doc_id, s, m, min(q) AS q FROM islands WHERE m >= greatest({LEAST}, {EXPONENT} * q) GROUP BY doc_id, s, m
    ), listed AS (
        SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id
    ), best AS (
        SELECT r.doc_id, s, m, q FROM runs r WHERE NOT EXISTS (
            SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND (
                o.m * r.q > r.m * o.q OR o.m * r.q = r.m * o.q AND (o.s < r.s OR o.s = r.s AND o.q < r.q)))
    ), kept AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words w
        WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = w.doc_id AND w.i >= r.s + r.q AND w.i < r.s + r.m) GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, m AS length, q AS period, 1000 * m // q AS exponent_milli,
        sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
    FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
)
def automaton_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_runs(repeated_words(table(spark, sf_dir, "documents")))
