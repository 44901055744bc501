"""Secret scans: wide candidate patterns, and a random forest that removes false positives.

A candidate is a value assigned to a telling name, which may be part of a longer one (``DB_PASSWORD``, ``accessToken``, ``tokenizer`` too), or a
long run of letters, digits and ``+ / _ -`` anywhere, a long name included.  A forest trained on labelled findings judges it by its length
and make-up, how usual its character transitions are, how much of it dictionary words cover, the path it was found under, and the
name, words and signs around it.  It learns from findings in drawn texts, see `secrets_examples`, and from any that callers have labelled.  Usual transitions and the dictionary are counted over all texts; both have a fixed size.

Defined cases: null and empty texts have no candidates; a null path is empty; a text of any length is scanned whole; rows that repeat an id, or have
none, are scanned each; without findings of both labels the probability is the share of label 1 (0 without any); an empty table gives no
findings; further columns are not carried, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.encoding import slices
from tarnlake.llm.secrets_examples import examples
from tarnlake.session import work_folder

#: Words of the dictionary, and their letters.
DICTIONARY_WORDS = 5000
WORD_LETTERS = (3, 8)
#: Findings the forest is trained on, at most about.
MOST_FINDINGS = 200_000
TREES, DEPTH, SEED = 60, 9, 11
#: Drawn texts the forest is trained on.
EXAMPLES = 8000
#: Characters looked at on either side.
AROUND = 60

_NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential"
_LOOSE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
# A name is a whole run that holds a telling word, so that no loose run can take it first; nothing is scanned twice.
_CANDIDATE = re.compile(
    rf"(?<![\w+/-])(?=[\w+/-]*?(?i:{_NAMES}))(?P<name>[\w+/-]++)[\"']?+\s*+[:=]\s*+[\"']?+(?P<assigned>[^\s\"']{{6,}})"
    rf"|(?P<loose>{_LOOSE.pattern})"
)
_NAMED = re.compile(rf"(?i){_NAMES}|\b(?:key|auth|login)\b")
# What stands before an assigned value, and names that only begin like a secret's or go on to say what else they are.
_NAME_BEFORE = re.compile(r"([\w+/-]+)[\"']?\s*[:=]\s*[\"']?$")
_PLAIN_NAME = re.compile(
    r"(?:password|passwd|pwd|secret|token|key|credential|PASSWORD|PASSWD|PWD|SECRET|TOKEN|KEY|CREDENTIAL|Password|Secret|Token|Key|Credential)"
    r"(?:(?!s\b|s_)[a-z]{2,}|[_-]?(?i:count|types?|limit|length|hint|field|names?|url|uri|path|file|policy|ttl|id|size|page|label|expiry|age)\b"
    r"|(?:Count|Type|Limit|Length|Hint|Field|Name|Url|Path|File|Policy|Ttl|Id|Size|Page|Label|Expiry|Age)\b)"
)
_REFERS = re.compile(r"(?i)\b(?:commit|sha-?\d*|md5|rev|revision|checksum|digest|tree|blob|parent|build|etag|hash|uuid|guid)\b[^\w]{0,3}$")
_PLACEHOLDER = re.compile(r"(?i)^[<$%{*(]|^(?:your|change|insert|example|none|null|true|false|todo|xxx)|\benviron|\w\(|^/\w+/")
_SEPARATORS = re.compile(r"[-_/+.]+")
_EXEMPT_PATH = re.compile(r"(?i)(?:^|[/_.-])(?:tests?|examples?|samples?|docs?|mocks?|fixtures?)(?:$|[/_.-])")
_LETTERS = re.compile("[a-z]+")

FEATURES = (
    "length",
    "digits",
    "uppers",
    "entropy",
    "changes",
    "transitions",
    "rarest_transition",
    "dictionary",
    "letters_known",
    "hex",
    "separators",
    "longest_part",
    "numbers",
    "assigned",
    "named",
    "plain_name",
    "refers",
    "placeholder",
    "quoted",
    "words_around",
    "path_depth",
    "path_exempt",
)
SCHEMA = "doc_id bigint, start bigint, length bigint, kind string, sha256 string, features array<double>"

_SIGNS = 64
_SIGN = np.full(256, _SIGNS - 1, dtype=np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"):
    _SIGN[ord(_c)] = _i


@dataclass(frozen=True)
class Language:
    """Log probabilities of one sign after another, and the most frequent words."""

    transitions: np.ndarray
    words: frozenset[str]


def learn_language(docs: DataFrame) -> Language:
    """Counts transitions and short words over all texts; a fixed number of rows comes to the driver."""

    def counted(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                words: Counter = Counter()
                pairs = np.zeros(_SIGNS * _SIGNS, dtype=np.int64)
                for text in texts[a:b]:
                    words.update(w for w in text.lower().split() if WORD_LETTERS[0] <= len(w) <= WORD_LETTERS[1] and w.isalpha())
                    signs = _SIGN[np.frombuffer(text.encode(), dtype=np.uint8)]
                    pairs += np.bincount(signs[:-1] * _SIGNS + signs[1:], minlength=_SIGNS * _SIGNS)
                keys = list(words) + [str(i) for i in np.flatnonzero(pairs)]
                counts = [*words.values(), *pairs[pairs > 0].tolist()]
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "n": pa.array(counts, pa.int64())})

    rows = docs.where("text is not null").select("text").mapInArrow(counted, "key string, n bigint")
    counts = rows.groupBy("key").agg(F.sum("n").alias("n"))
    folder = work_folder(docs.sparkSession)
    counts.write.parquet(folder)
    counts = docs.sparkSession.read.schema("key string, n bigint").parquet(folder)
    number = F.col("key").rlike("^[0-9]+$")
    table = np.ones((_SIGNS, _SIGNS))
    for key, n in counts.where(number).collect():
        table[int(key) // _SIGNS, int(key) % _SIGNS] += n
    words = counts.where(~number).orderBy(F.desc("n"), "key").limit(DICTIONARY_WORDS).collect()
    return Language(np.log(table / table.sum(axis=1, keepdims=True)), frozenset(key for key, _ in words))


def covered(text: str, words: frozenset[str]) -> float:
    """The share of a text's characters that dictionary words cover, taking the longest word from the left."""
    total = 0
    for run in _LETTERS.findall(text.lower()):
        i = 0
        while i < len(run):
            size = next((n for n in range(min(WORD_LETTERS[1], len(run) - i), WORD_LETTERS[0] - 1, -1) if run[i : i + n] in words), 0)
            total += size
            i += size or 1
    return total / len(text) if text else 0.0


def features(value: str, before: str, after: str, path: str, assigned: bool, language: Language) -> list[float]:
    """The numbers that a candidate is judged by, in the order of `FEATURES`."""
    count = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in value]
    signs = _SIGN[np.frombuffer(value.encode(), dtype=np.uint8)]
    steps = language.transitions[signs[:-1], signs[1:]] if len(signs) > 1 else np.zeros(1)
    around = [w.strip(".,;:!?'\"()=").lower() for w in before.split()[-4:-1] + after.split()[1:4]]
    known = sum(1 for w in around if w and (w in language.words or covered(w, language.words) > 0.5))
    parts = [part for part in _SEPARATORS.split(value) if part]
    name = _NAME_BEFORE.search(before)
    letters = kinds.count("u") + kinds.count("l")
    known_share = covered(value, language.words)
    return [
        math.log(count),
        kinds.count("d") / count,
        kinds.count("u") / count,
        -sum(n / count * math.log2(n / count) for n in Counter(value).values()),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / count,
        float(steps.mean()),
        float(steps.min()),
        known_share,
        known_share * count / letters if letters else 0.0,
        sum(c in "0123456789abcdefABCDEF" for c in value) / count,
        float(len(parts) - 1),
        max(map(len, parts), default=0) / count,
        # Parts that are all digits: dates, pages and numbers of parts, unlike digits inside a run.
        sum(len(part) for part in parts if part.isdigit()) / max(1, kinds.count("d")),
        float(assigned),
        float(bool(_NAMED.search(before[-30:]))),
        float(bool(name and _PLAIN_NAME.search(name[1]))),
        float(bool(_REFERS.search(before[-30:]))),
        float(bool(_PLACEHOLDER.search(value))),
        float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
        known / len(around) if around else 0.0,
        float(path.count("/")),
        float(bool(_EXEMPT_PATH.search(path))),
    ]


def candidates(text: str, path: str, language: Language) -> list[tuple[int, int, str, str, list[float]]]:
    """``(start, length, kind, sha256, features)`` of each candidate, counted in characters."""
    spans = []
    for match in _CANDIDATE.finditer(text):
        if match["assigned"]:
            # A long name may itself be a key, such as one padded by an equals sign.
            spans += [(*run.span(), "loose") for run in _LOOSE.finditer(text, match.start("name"), match.start("assigned"))]
        spans.append((*match.span(match.lastgroup), match.lastgroup))
    found = []
    for start, end, kind in spans:
        value = text[start:end]
        numbers = features(value, text[max(0, start - AROUND) : start], text[end : end + AROUND], path, kind == "assigned", language)
        found.append((start, end - start, kind, hashlib.sha256(value.encode()).hexdigest(), numbers))
    return found


def find_candidates(docs: DataFrame, language: Language, path: str = "source") -> DataFrame:
    """All candidates in the texts of ``docs``, with their features; ``path`` names the column with a document's path."""

    def run(batches):
        for batch in batches:
            rows = [
                (name, *found)
                for name, text, where in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "path")), strict=True)
                for found in candidates(text, where, language)
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64()))
            names = ("doc_id", "start", "length", "kind", "sha256", "features")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    texts = docs.where("text is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path")
    )
    return texts.mapInArrow(run, SCHEMA)


def example_findings(spark: SparkSession, language: Language, count: int = EXAMPLES, seed: int = SEED) -> DataFrame:
    """Findings in drawn texts, of which those that are a text's value have its ``label``."""
    rows = examples(sorted(language.words), count, seed)
    texts = spark.createDataFrame(rows, "doc_id bigint, text string, source string, value string, label int")
    labels = texts.select("doc_id", F.sha2(F.col("value").cast("binary"), 256).alias("sha256"), "label")
    return find_candidates(texts, language, "source").join(labels, ["doc_id", "sha256"])


def train(findings: DataFrame, most: int = MOST_FINDINGS) -> RandomForestClassificationModel | float:
    """A forest from ``features`` and ``label`` (0 or 1, null left out); without both labels, the share of label 1."""
    known = findings.where("label is not null").select("features", F.col("label").cast("double").alias("label"))
    total, ones = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < total:
        return ones / total if total else 0.0
    if total > most:
        known = known.where(F.pmod(F.xxhash64("features"), F.lit(1_000_000)) < int(1_000_000 * most / total))
    rows = known.select(array_to_vector("features").alias("features"), "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)


def judge(findings: DataFrame, model: RandomForestClassificationModel | float) -> DataFrame:
    """``findings`` with ``probability`` of being a secret in place of the features."""
    if isinstance(model, float):
        return findings.drop("features").withColumn("probability", F.lit(model))
    scored = model.transform(findings.withColumn("vector", array_to_vector("features")).drop("features").withColumnRenamed("vector", "features"))
    probability = vector_to_array("probability")[1]
    return scored.withColumn("secret", probability).drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed(
        "secret", "probability"
    )
