"""URL filters: rules indexed by their rarest literal token, so that a URL runs few regular expressions.

A URL's address is its host, lower-cased, and its path.  Two kinds of rules apply to it:

* domain rules such as ``example.net/en/`` fit a host, its subdomains, and paths that start so; the longest wins;
* pattern rules such as ``^cheap*pills^`` fit anywhere, whatever the case; ``^`` is an end of the address or any sign but
  a letter or digit, and ``*`` any text.  They decide where no domain rule does: an allowing one wins over blocking ones, then the longest.

What no rule fits is allowed.  A literal token is a run of letters and digits that the rule forces to
stand alone, so an address can only fit if it has that token.  Of a rule's tokens the one that the fewest rows hold is its key,
as counted over the whole table; rules without any are tried on every address.

Defined cases: a null URL, or one without ``://``, has an empty host and path, which only patterns can fit; an empty table gives no rows; repeated rows are
judged alike; a URL of any length is read whole; of fitting rules of equal length the first by its text wins.  All columns stay; those named like an added one (``host path rule pattern verdict``) are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: The rule index is sent to every executor, so the list has a bound.
MOST_RULES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(_UPPER, _LOWER)
_TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """A rule as written, what it says, and whether it is a domain rule."""

    text: str
    verdict: str
    domain: bool = True

    def regex(self) -> str:
        if not self.domain:
            signs = {"^": r"(?:\A|[^A-Za-z0-9]|\Z)", "*": "(?s:.*)"}
            return "(?ai:" + "".join(signs.get(c, re.escape(c)) for c in self.text) + ")"
        host, path = split_rule(self.text)
        return rf"\A(?:[^/]*\.)?{re.escape(host)}" + (re.escape(path) if path else r"(?=/|\Z)")

    def tokens(self) -> list[str]:
        """Runs of letters and digits that an address must hold as whole tokens."""
        if self.domain:
            host, path = split_rule(self.text)
            # A host ends where its path begins or the address ends; a path may go on.
            text = "^" + host + (path + "*" if path else "^")
        else:
            text = "*" + self.text + "*"
        text = text.translate(_TO_LOWER)
        return [m[0] for m in _TOKEN.finditer(text) if text[m.start() - 1] != "*" and text[m.end()] != "*"]


def split_rule(text: str) -> tuple[str, str]:
    """Host, lower-cased, and path of a domain rule."""
    host, slash, path = text.partition("/")
    return host.translate(_TO_LOWER), slash + path


def address_columns(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def token_counts(addresses: DataFrame, column: str, wanted: set[str]) -> dict[str, int]:
    """In how many rows each wanted token stands; at most as many as the rules have tokens."""
    lower = F.translate(column, _UPPER, _LOWER)
    found = addresses.select(F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit("[a-z0-9]+"), F.lit(0)))).alias("t"))
    counts = found.where(F.col("t").isin(sorted(wanted))).groupBy("t").count()
    return {row["t"]: row["count"] for row in counts.collect()}


def index_rules(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rule numbers by their rarest token, and those without one."""
    index: dict[str, list[int]] = {}
    rest = []
    for number, rule in enumerate(rules):
        tokens = rule.tokens()
        if tokens:
            index.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(number)
        else:
            rest.append(number)
    return index, rest


class Matcher:
    """Judges addresses; compiles a rule when it is first tried."""

    def __init__(self, rules: list[Rule], index: dict[str, list[int]], rest: list[int]):
        self.rules, self.index, self.rest = rules, index, rest
        self._compiled: dict[int, re.Pattern] = {}
        self.tried = 0

    def _fits(self, number: int, address: str) -> bool:
        if number not in self._compiled:
            self._compiled[number] = re.compile(self.rules[number].regex())
        self.tried += 1
        return self._compiled[number].search(address) is not None

    def judge(self, address: str) -> tuple[str | None, str | None, str]:
        """The domain rule and the pattern that fit best, and the verdict."""
        numbers = set(self.rest)
        for token in set(_TOKEN.findall(address.translate(_TO_LOWER))):
            numbers.update(self.index.get(token, ()))
        fitting = [self.rules[n] for n in numbers if self._fits(n, address)]
        domain = min((r for r in fitting if r.domain), key=lambda r: (-len(r.text), r.text), default=None)
        pattern = min(
            (r for r in fitting if not r.domain), key=lambda r: (r.verdict != ALLOW, -len(r.text), r.text), default=None
        )
        decided = domain or pattern
        return domain and domain.text, pattern and pattern.text, decided.verdict if decided else ALLOW


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (domain rule that fits), ``pattern`` (pattern rule that fits) and ``verdict``."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; the index is sent to every executor and holds {MOST_RULES} at most")
    host, path = address_columns(F.col(url))
    rows = pages.withColumns({"host": host, "path": path})
    wanted = {token for rule in rules for token in rule.tokens()}
    counts = token_counts(rows.select(F.concat("host", "path").alias("address")), "address", wanted)
    index, rest = index_rules(rules, counts)

    @F.pandas_udf("rule string, pattern string, verdict string")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(rules, index, rest)
        for addresses in batches:
            found = [matcher.judge(address) for address in addresses]
            yield pd.DataFrame(found, columns=["rule", "pattern", "verdict"])

    verdicts = rows.withColumn("verdict", judged(F.concat("host", "path")))
    return verdicts.withColumns({c: F.col(f"verdict.{c}") for c in ("rule", "pattern", "verdict")})
