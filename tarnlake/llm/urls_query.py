"""Query 1: every page's URL judged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm.registry import query, table
from tarnlake.llm.urls import ALLOW, BLOCK, Rule, judge_urls, split_rule

DOMAIN_RULES = [
    Rule("net/", BLOCK),
    Rule("example.net/en/", ALLOW),
    Rule("example.com/de/", BLOCK),
    Rule("org/fr/", ALLOW),
]
#: Words of hosts and paths that are not wanted.
UNWANTED = "adult ads bets casino gambling pills porn spam viagra xxx".split()
PATTERN_RULES = [Rule(f"^{word}^", BLOCK, domain=False) for word in UNWANTED]
PATTERN_RULES += [Rule("^free*coupons^", BLOCK, domain=False), Rule("^casino^museum^", ALLOW, domain=False)]


def _sql_regex(rule: Rule) -> str:
    if rule.domain:
        host, path = split_rule(rule.text)
        return f"^([^/]*[.])?{host.replace('.', '[.]')}{path}"
    inner = rule.text.strip("^").replace("^", "[^A-Za-z0-9]").replace("*", ".*")
    return f"(?is)(^|[^A-Za-z0-9]){inner}($|[^A-Za-z0-9])"


def _sql_choice(rules: list[Rule], value: str) -> str:
    ordered = sorted(rules, key=lambda r: (not r.domain and r.verdict != ALLOW, -len(r.text), r.text))
    cases = " ".join(f"WHEN regexp_matches(address, '{_sql_regex(r)}') THEN '{getattr(r, value)}'" for r in ordered)
    return f"CASE {cases} END"


@query(
    "op1_url_filter",
    f"""
    WITH rest AS (
        SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r
        FROM pages
    ), parts AS (
        SELECT page_id, lower(regexp_extract(coalesce(r, ''), '^([^/?#]*)([^?#]*)', 1)) AS host,
            regexp_extract(coalesce(r, ''), '^([^/?#]*)([^?#]*)', 2) AS path
        FROM rest
    ), addresses AS (SELECT *, host || path AS address FROM parts)
    SELECT page_id, host, path, {_sql_choice(DOMAIN_RULES, "text")} AS rule,
        coalesce({_sql_choice(DOMAIN_RULES, "verdict")}, {_sql_choice(PATTERN_RULES, "verdict")}, 'allow') AS verdict,
        {_sql_choice(PATTERN_RULES, "text")} AS pattern
    FROM addresses
    """,
)
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), DOMAIN_RULES + PATTERN_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "pattern")
