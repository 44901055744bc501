"""URL rules against trying every rule on every address."""

import random
import re

from tarnlake.llm import urls
from tarnlake.llm.urls import ALLOW, BLOCK, Matcher, Rule
from tarnlake.llm.urls_query import DOMAIN_RULES, PATTERN_RULES

RULES = [
    *DOMAIN_RULES,
    *PATTERN_RULES,
    Rule("example.net", BLOCK),
    Rule("a.example.net/En", ALLOW),
    Rule("xn--p/", BLOCK),
    Rule("ads*track", BLOCK, domain=False),
    Rule("^", ALLOW, domain=False),
]


def plain(rules, address):
    fitting = [r for r in rules if re.search(r.regex(), address)]
    domain = sorted((r for r in fitting if r.domain), key=lambda r: (-len(r.text), r.text))
    pattern = sorted((r for r in fitting if not r.domain), key=lambda r: (r.verdict != ALLOW, -len(r.text), r.text))
    best = (domain + pattern)[:1]
    return (domain[0].text if domain else None, pattern[0].text if pattern else None, best[0].verdict if best else ALLOW)


def fits(rule, host, path):
    """A domain rule by its definition."""
    of, start = urls.split_rule(rule.text)
    return (host == of or host.endswith("." + of)) and path.startswith(start)


def addresses(count):
    draw = random.Random(3)
    hosts = ["example.net", "a.example.net", "badexample.net", "x.org", "net", "casino-win.example.com", "ads-x-track.org", "", "K.net"]
    paths = ["", "/", "/en/", "/En/x", "/fr/1", "/de/casino", "/pills", "/PILLS/a", "/a*b", "/casino/museum/1", "/free-big-coupons"]
    return [(draw.choice(hosts), draw.choice(paths)) for _ in range(count)]


def test_index_finds_what_trying_all_rules_finds():
    for rules in (RULES, RULES[:-1], DOMAIN_RULES):
        matcher = Matcher(rules, *urls.index_rules(rules, {"example": 9, "net": 5, "en": 1}))
        for host, path in addresses(800):
            assert matcher.judge(host + path) == plain(rules, host + path)
            best = max((r for r in rules if r.domain and fits(r, host, path)), key=lambda r: len(r.text), default=None)
            assert matcher.judge(host + path)[0] == (best and best.text)


def test_few_rules_are_tried():
    rules = [Rule(f"site{i}.example.com/", BLOCK) for i in range(2000)]
    matcher = Matcher(rules, *urls.index_rules(rules, {"example": 100, "com": 100}))
    assert matcher.judge("www.site7.example.com/x") == ("site7.example.com/", None, BLOCK)
    assert matcher.tried == 1


def test_columns(spark):
    pages = [
        (1, "http://Sub.EXAMPLE.net/en/1?x=/fr/", "h"),
        (2, "https://x.org/fr/#a", None),
        (3, "no scheme/net/", "h"),
        (4, None, "h"),
        (5, "http://casino.net", "h"),
        (5, "http://casino.net", "h"),
        (None, "a://b://c.net/?", "h"),
        (6, "http://x.net#/en/" + "y" * 100_000, "h"),
        (7, "", "h"),
    ]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, host string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(frame, RULES[:-5]).collect()}
    assert got == {
        (1, "sub.example.net", "/en/1", "example.net/en/", ALLOW),
        (2, "x.org", "/fr/", "org/fr/", ALLOW),
        (3, "", "", None, ALLOW),
        (4, "", "", None, ALLOW),
        (5, "casino.net", "", None, BLOCK),
        (None, "b:", "//c.net/", None, ALLOW),
        (6, "x.net", "", None, ALLOW),
        (7, "", "", None, ALLOW),
    }
    assert urls.judge_urls(frame, RULES).count() == len(pages)
    assert urls.judge_urls(frame.limit(0), RULES).collect() == []
    assert urls.judge_urls(frame, []).where("verdict <> 'allow'").collect() == []


def test_rules_of_equal_length(spark):
    rules = [Rule("^pills^", BLOCK, domain=False), Rule("^adult^", BLOCK, domain=False), Rule("a.org/x", BLOCK), Rule("a.org/y", ALLOW)]
    addresses = ["http://a.org/x/adult/pills", "http://b.org/pills?" + "x" * 100_000, "http://b.org/" + "x/" * 100_000 + "adult/pills"]
    frame = spark.createDataFrame([(a,) for a in addresses], "url string")
    got = urls.judge_urls(frame, rules).select("rule", "pattern", "verdict").collect()
    assert [tuple(r) for r in got] == [("a.org/x", "^adult^", BLOCK), (None, "^pills^", BLOCK), (None, "^adult^", BLOCK)]
