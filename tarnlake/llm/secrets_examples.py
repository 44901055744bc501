"""Labelled findings to train the secret scan on: secrets and harmless values of many forms, drawn by rule.

A form's label follows from how its value was made, random or from words, dates and references, and from the name and the words it was set
beside, not from how the value looks.  Words come from the corpus's own dictionary.  Draws depend on a seed alone.
"""

from __future__ import annotations

import random
import string
import uuid

HEX, BASE62 = "0123456789abcdef", string.ascii_letters + string.digits
#: Names that secrets are given under, with what stands around them in longer names.
NAMES = "password passwd pwd secret token api_key apiKey access_key access-key credential credentials".split()
FRONTS = ["", "", "db_", "DB_", "my-", "client_", "aws_", "root", "prod-"]
#: Names that hold a telling word and are not a secret's.
PLAIN_NAMES = (
    "tokenizer tokenize token_count tokenCount token_type token_limit max_token_length secretariat password_hint password_length "
    "passwordField secret_name secretName token_url credential_type api_key_id password_policy pwd_path token_ttl"
).split()
#: Words that say what follows is a reference.
REFERENCES = "commit sha sha256 sha1 md5 rev revision checksum digest tree blob build etag hash".split()
SIGNS = "&!@#%?."


def _word(draw: random.Random, words: list[str]) -> str:
    return draw.choice(words)


def _text_of(draw: random.Random, signs: str, count: int) -> str:
    return "".join(draw.choices(signs, k=count))


def _assigned(draw: random.Random, name: str, value: str) -> str:
    return draw.choice(["{}={}", "{} = {}", "{}: {}", '{} = "{}"', "{}='{}'", '"{}": "{}"', '{}: "{}"']).format(name, value)


def _name(draw: random.Random) -> str:
    name = draw.choice(FRONTS) + draw.choice(NAMES)
    return draw.choice([name, name, name.upper(), name + "1"])


def _random_secret(draw, words):
    signs = draw.choice([HEX, BASE62, BASE62 + SIGNS, string.ascii_lowercase + string.digits])
    return _text_of(draw, signs, draw.randrange(10, 44)) + draw.choice(string.digits)


def _human_secret(draw, words):
    """One word or two, changed and lengthened as people do."""
    word = _word(draw, words)
    swapped = word.translate(str.maketrans("aeios", "43105")) if draw.random() < 0.5 else word
    extra = _text_of(draw, string.digits, draw.randrange(1, 5)) + draw.choice([*SIGNS, ""])
    return draw.choice([swapped.capitalize(), swapped]) + extra + draw.choice([_word(draw, words), _text_of(draw, BASE62, 4)])


def _key(draw, words):
    """What stands alone: a provider's prefix and random signs, or random signs alone."""
    prefix = _text_of(draw, string.ascii_letters, draw.randrange(2, 5))
    return draw.choice(
        [
            prefix.upper() + _text_of(draw, string.ascii_uppercase + string.digits, 16),
            prefix.lower() + "_" + _text_of(draw, BASE62, draw.randrange(24, 40)),
            _text_of(draw, HEX, draw.choice([32, 40, 64])),
            _text_of(draw, BASE62 + "+/", draw.randrange(24, 64)),
        ]
    )


def _slug(draw, words):
    parts = [_word(draw, words) for _ in range(draw.randrange(3, 7))]
    parts.insert(draw.randrange(1, len(parts) + 1), str(draw.randrange(1, 3000)))
    return draw.choice("-_").join(p.capitalize() if draw.random() < 0.2 else p for p in parts)


def _path(draw, words):
    date = f"{draw.randrange(1995, 2026)}/{draw.randrange(1, 13):02d}" + draw.choice(["", f"/{draw.randrange(1, 29):02d}"])
    parts = [_word(draw, words) for _ in range(draw.randrange(1, 4))]
    return "/".join(draw.choice([[*parts, date, _slug(draw, words)], [date, *parts, _word(draw, words)], [*parts, _slug(draw, words)]]))


def _identifier(draw, words):
    """Names as programs have them, releases, and runs of one sign."""
    parts = [_word(draw, words) for _ in range(draw.randrange(3, 6))]
    return draw.choice(
        [
            parts[0] + "".join(p.capitalize() for p in parts[1:]) + str(draw.randrange(1, 30)),
            "_".join(parts).upper() + f"_V{draw.randrange(9)}",
            f"release-{draw.randrange(2000, 2030)}-{draw.randrange(1, 13):02d}-{draw.randrange(1, 29):02d}-rc{draw.randrange(9)}",
            draw.choice("-_=0x") * draw.randrange(16, 60),
            "".join(parts),
        ]
    )


def _number(draw, words):
    digits = _text_of(draw, string.digits, 17)
    return draw.choice([digits[:16], digits, f"978-{digits[0]}-{digits[1:3]}-{digits[3:9]}-{digits[9]}", f"+{digits[:2]}-{digits[2:5]}-{digits[5:13]}"])


def _placeholder(draw, words):
    word = _word(draw, words)
    return draw.choice(
        [f"${{{word.upper()}_VALUE}}", f"<your-{word}-here>", "changeme", f"os.environ[{word}]", "xxxxxxxxxxxx", "********", f"get_{word}()", f"%({word})s", f"/etc/{word}/{word}.txt"]
    )


def _uuid(draw, words):
    made = str(uuid.UUID(int=draw.getrandbits(128), version=4))
    return draw.choice([made, made, made.upper()])


def _short(draw, words):
    return draw.choice([_slug(draw, words), _text_of(draw, string.digits, draw.randrange(6, 10)), "-".join(draw.choices(words, k=3)), f"{_word(draw, words)}_{_word(draw, words)}_{draw.randrange(9)}"])


#: (label, how often, what stands in the text, as a function of draw and words that gives the text and the value)
FORMS = (
    (1, 4, lambda d, w, v=_random_secret: _named(d, w, _name(d), v)),
    (1, 2, lambda d, w, v=_human_secret: _named(d, w, _name(d), v)),
    (1, 3, lambda d, w, v=_key: _alone(d, w, "", v)),
    (0, 2, lambda d, w, v=_uuid: _alone(d, w, d.choice(["", "", "id ", "request ", "id="]), v)),
    (0, 2, lambda d, w, v=None: _alone(d, w, d.choice(REFERENCES) + d.choice([" ", ": ", ":", "="]), lambda d, w: _text_of(d, HEX, d.choice([16, 32, 40, 64])))),
    (0, 2, lambda d, w, v=_path: _alone(d, w, d.choice(["", "", "see ", "https://example.org/"]), v)),
    (0, 2, lambda d, w, v=_slug: _alone(d, w, "", v)),
    (0, 2, lambda d, w, v=_identifier: _alone(d, w, "", v)),
    (0, 1, lambda d, w, v=_number: _alone(d, w, "", v)),
    (0, 2, lambda d, w, v=_slug: _named(d, w, _name(d), v)),
    (0, 1, lambda d, w, v=_placeholder: _named(d, w, _name(d), v)),
    (0, 3, lambda d, w, v=_short: _named(d, w, d.choice(PLAIN_NAMES), v)),
)


def _named(draw, words, name, make):
    value = make(draw, words)
    return _assigned(draw, name, value), value


def _alone(draw, words, before, make):
    value = make(draw, words)
    return before + value + draw.choice(["", "", ".", ",", '"', ")"]), value


def examples(words: list[str], count: int, seed: int) -> list[tuple[int, str, str, str, int]]:
    """``(id, text, path, value, label)`` of ``count`` texts that hold one value each."""
    draw = random.Random(seed)
    long = sorted(w for w in words if len(w) >= 4 and w.isascii()) or sorted(w for w in words if w.isascii())
    if len(long) < 20:
        # A corpus without words: pronounceable ones.
        long = long + ["".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(draw.randrange(2, 4))) for _ in range(200)]
    forms = [(label, make) for label, often, make in FORMS for _ in range(often)]
    rows = []
    for i in range(count):
        label, make = forms[i % len(forms)]
        inner, value = make(draw, long)
        around = [" ".join(draw.choices(long, k=draw.randrange(2, 12))) for _ in range(2)]
        path = "/".join(draw.choices(long, k=draw.randrange(1, 5))) if draw.random() < 0.5 else f"src{draw.randrange(30)}"
        rows.append((i, f"{around[0]} {inner} {around[1]}", path, value, label))
    return rows
