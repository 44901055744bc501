"""Query 6: near duplicates among all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm.near import near_components
from tarnlake.llm.registry import query, table

WORDS, PERCENT = 3, 85


@query(
    "op6_fast_sketch_near_dedup",
    f"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'
        ), lambda x: x <> '') AS w
        FROM documents
    ), shingles AS (
        SELECT DISTINCT doc_id, array_to_string(w[i : i + {WORDS - 1}], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS}, 0) + 2)) AS i FROM words WHERE len(w) > 0)
    ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
    ), common AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
    ), links AS (
        SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
        WHERE 100 * c.n >= {PERCENT} * (x.n + y.n - c.n)
    ), reach AS (
        SELECT doc_id, doc_id AS other FROM documents
        UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
    ), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes s USING (doc_id)
    """,
)
def fast_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), WORDS, PERCENT)
