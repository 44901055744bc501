"""Secret scan: candidates against the pattern, held-out accuracy on planted findings."""

import hashlib
import random
import uuid
from collections import Counter

import numpy as np

from tarnlake.llm import secrets
from tarnlake.llm.registry import QUERIES, table
from tarnlake.llm.secrets_examples import FORMS, examples
from tarnlake.llm.secrets_query import labelled, trained

SCHEMA = "doc_id bigint, text string, source string, length string"


def corpus():
    draw = random.Random(6)
    syllables = "the and ing tion er on an re he in ed nd ha es or ti".split()
    word = lambda: "".join(draw.choices(syllables, k=draw.randrange(1, 8)))
    token = lambda n: "".join(draw.choices("0123456789abcdef", k=n))
    rows, truth = [], {}
    for i in range(240):
        secret = [f"password={token(18)}", "AKIA" + "".join(draw.choices("ABCDEFGHIJ0123456789", k=16)), token(40)][i % 3]
        body = [word() for _ in range(60)]
        truth[i] = secret.removeprefix("password=")
        rows.append((i, " ".join(body[:30] + [secret] + body[30:] + [str(draw.randrange(10**15, 10**16))]), f"src/app{i}.py", "k"))
    return rows, truth


def test_forest_keeps_secrets_and_drops_words(spark):
    rows, truth = corpus()
    odd = [(900, None, None, None), (901, "", "", ""), (902, "token = ", "a/tests/b", ""), (None, f"secret: {'ab12' * 5}", None, None)]
    odd += [(903, "plain words " * 50_000 + "password=abc123def456", "x", "")]
    frame = spark.createDataFrame(rows + odd + rows[:1], SCHEMA).repartition(3)
    language = secrets.learn_language(frame)
    found = secrets.find_candidates(frame, language, "source")
    model = trained(found.where("doc_id % 2 = 0"), language)
    got = secrets.judge(found, model).collect()
    texts = {r[0]: r[1] for r in rows + odd}
    judged = {}
    for r in got:
        value = texts[r.doc_id][r.start : r.start + r.length]
        judged.setdefault(r.doc_id, []).append((value, r.probability >= 0.5))
    for i, secret in truth.items():
        if i % 2:
            assert (secret, True) in judged[i]
            assert not any(kept for value, kept in judged[i] if value != secret)
    assert (("ab12" * 5, True) in judged[None]) and judged[903][-1][0] == "abc123def456"
    assert len(judged[0]) == 2 * len([m for m in secrets._CANDIDATE.finditer(texts[0])])


def test_odd_inputs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    language = secrets.learn_language(empty)
    found = secrets.find_candidates(empty, language, "source")
    assert found.collect() == []
    model = secrets.train(labelled(found))
    assert model == 0.0 and secrets.judge(found, model).collect() == []


NAMED = {
    "DB_PASSWORD=hunter2pass": "hunter2pass",
    'db_password = "Tr0ub4dor&3"': "Tr0ub4dor&3",
    'client_secret: "a8f3k2p9"': "a8f3k2p9",
    "auth_token=abc123def456": "abc123def456",
    'credentials="ab12cd34"': "ab12cd34",
    '{"accessToken": "ab12cd34ef56"}': "ab12cd34ef56",
    "production-db-password: s3cr3tpw9": "s3cr3tpw9",
    "etc/app/production-db-password: s3cr3t&pw!9": "s3cr3t&pw!9",
    "password1 = pa55@word": "pa55@word",
    "pässwörter_token=abc123": "abc123",
}


def test_names_with_more_around_them():
    language = secrets.Language(np.log(np.full((64, 64), 1 / 64)), frozenset())
    for text, value in NAMED.items():
        found = secrets.candidates(f"see {text} there", "a/b", language)
        assert [f"see {text} there"[s : s + n] for s, n, kind, *_ in found if kind == "assigned"] == [value]
        assert found[-1][4][secrets.FEATURES.index("named")] == 1
    padded = "Q0xJRU5UtokenU0VDUkVU= followed"
    kinds = {padded[s : s + n]: kind for s, n, kind, *_ in secrets.candidates(padded, "", language)}
    assert kinds == {"Q0xJRU5UtokenU0VDUkVU=": "loose", "followed": "assigned"}
    # Long runs of names, blanks and signs take linear time.
    for unit in ("pwd", "pwd ", "token= ", "x-", "pwd=", "é", " "):
        secrets.candidates(unit * 200_000 + " token", "", language)


def test_forest_keeps_values_under_longer_names(spark):
    rows, _ = corpus()
    draw = random.Random(12)
    names = ["DB_PASSWORD={}", 'client_secret: "{}"', 'accessToken": "{}"', "production-db-password: {}"]
    drawn = ["".join(draw.choices("0123456789abcdefghijkmnpqrs&@!", k=9)) + "4x" for _ in range(40)]
    rows += [(1000 + i, "and the thing " + names[i % 4].format(v) + " in the end", f"src/z{i}.py", "k") for i, v in enumerate(drawn)]
    frame = spark.createDataFrame(rows, SCHEMA)
    language = secrets.learn_language(frame)
    found = secrets.find_candidates(frame, language, "source")
    model = trained(found.where("doc_id < 1000 and doc_id % 2 = 0"), language)
    kept = {(r.doc_id, r.sha256) for r in secrets.judge(found, model).where("doc_id >= 1000 and probability >= 0.5").collect()}
    assert {(1000 + i, hashlib.sha256(v.encode()).hexdigest()) for i, v in enumerate(drawn)} <= kept


def test_features():
    language = secrets.Language(np.log(np.full((64, 64), 1 / 64)), frozenset({"the", "ing", "there"}))
    assert secrets.covered("therething", language.words) == 0.8
    number = dict(zip(secrets.FEATURES, secrets.features("AB12", 'api_key="', '" x', "a/test/b", True, language), strict=True))
    assert number["digits"] == number["uppers"] == 0.5 and number["quoted"] == number["named"] == number["path_exempt"] == 1
    assert number["changes"] == 0.25 and number["path_depth"] == 2


def planted():
    """``(kind, label, text before, value)``, of words and names that the drawn examples don't have."""
    draw = random.Random(99)
    of = lambda signs, n: "".join(draw.choices(signs, k=n))
    base = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = "how to fix the water pump guide for winter garden see page of manual chapter history report summer kitchen notes".split()
    for i in range(20):
        yield "uuid", 0, "", str(uuid.UUID(int=draw.getrandbits(128), version=4))
        yield "commit", 0, "commit ", of("0123456789abcdef", 40)
        yield "path", 0, "", f"archive/{draw.randrange(1990, 2024)}/{draw.randrange(1, 13):02d}/{'-'.join(draw.choices(words, k=3))}"
        yield "slug", 0, "", f"{'-'.join(draw.choices(words, k=3))}-{draw.randrange(2, 99)}-{draw.choice(words)}"
        yield "page", 0, "password: ", f"see-page-{i}-of-manual"
        yield "person", 0, "secretary: ", f"Miss_Jones_{i}"
        yield "count", 0, "token_count=", str(10**7 + i * 1234567)
        yield "model", 0, "tokenizer = ", f"bert-base-v{i}"
        yield "hex", 1, "password=", of("0123456789abcdef", 18)
        yield "token", 1, 'token = "', of("0123456789abcdef", 40)
        yield "key", 1, "", "AKIA" + of(base[:26] + "0123456789", 16)
        yield "prefixed", 1, "", "ghp_" + of(base, 36)
        yield "human", 1, "DB_PASSWORD=", draw.choice(["hunter", "dragon", "monkey"]) + of("0123456789", 3) + draw.choice("!@&") + of(base, 3)


def test_harmless_values_go_and_secrets_stay(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    language = secrets.learn_language(docs)
    model = trained(secrets.find_candidates(docs, language), language)
    values = list(planted())
    rows = [(i, f"and the tion of {before}{value} ing here", f"src{i % 20}") for i, (_, _, before, value) in enumerate(values)]
    found = secrets.find_candidates(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), language)
    kept = {(r.doc_id, r.sha256) for r in secrets.judge(found, model).where("probability >= 0.5").collect()}
    caught = Counter()
    for i, (kind, label, _, value) in enumerate(values):
        caught[label, kind] += (i, hashlib.sha256(value.encode()).hexdigest()) in kept
    clean = [n for (label, _), n in caught.items() if not label]
    assert sum(clean) <= 0.1 * 160 and max(clean) <= 10, caught
    assert sum(n for (label, _), n in caught.items() if label) >= 0.95 * 100, caught


def test_query(spark, sf_dir):
    """Every candidate of every text once, and keys of a known form kept."""
    rows = QUERIES["op2_forest_secret_scan"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    language = secrets.Language(np.log(np.full((64, 64), 1 / 64)), frozenset())
    want = sorted((i, *found[:4]) for i, t in texts.items() for found in secrets.candidates(t, "", language))
    assert sorted((r.doc_id, r.start, r.length, r.kind, r.sha256) for r in rows) == want
    for r in rows:
        value = texts[r.doc_id][r.start : r.start + r.length]
        if value.isalpha() or value.isdigit():
            assert r.is_secret == (r.kind == "assigned" or (len(value) == 20 and value.startswith("AKIA")))
        elif value.startswith("AKIA") or r.kind == "assigned":
            assert r.is_secret


def test_examples():
    drawn = examples(["alpha", "bravo", "delta"], 500, 3)
    assert drawn == examples(["delta", "alpha", "bravo"], 500, 3) and drawn != examples(["alpha", "bravo", "delta"], 500, 4)
    assert all(value in text for _, text, _, value, _ in drawn) and {r[4] for r in drawn} == {0, 1}
    assert len(examples([], 60, 1)) == 60 and sum(often for _, often, _ in FORMS) < 60
