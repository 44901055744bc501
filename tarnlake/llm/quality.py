"""Quality classifier: a sparse ensemble of rules over text statistics, scored by Spark column expressions.

Trees are grown on labelled rows; every path from a root to a node below it is a rule, a conjunction of comparisons of
statistics.  A logistic regression with an L1 penalty weighs the rules and drops most of them.  What is left is a sum of
weighted conditions, which compiles into one column expression over the statistics.

Statistics cover the whole text.  The trees and weights may be fitted on a bounded part of the labelled rows, chosen by a hash of their ids
(`MOST_ROWS`); everything else covers all rows.

Defined cases: a null text is empty, and an empty text has all statistics 0 and the score that follows from them; labels that
repeat a ``doc_id`` are averaged, from one half up counting as 1; null labels and labels of no document are left out; without labels of both
kinds every score is the share of label 1 (one half without any); repeated rows are scored alike; an empty table gives no
rows.  Further columns, whatever their names, don't matter to a score.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.session import work_folder

#: Labelled rows that trees and weights are fitted on, at most about.
MOST_ROWS = 200_000
TREES, DEPTH, SEED = 40, 3, 7
#: Weight of the L1 penalty, and its steps at most.
PENALTY, STEPS = 0.0005, 60
#: Distinct words are counted within blocks of as many words, since their share falls with a text's length.
BLOCK_WORDS = 100

STATISTICS = (
    "log_chars",
    "log_words",
    "word_chars",
    "upper_share",
    "digit_share",
    "blank_share",
    "point_share",
    "symbol_share",
    "foreign_share",
    "distinct_words",
    "top_word",
    "repeats",
    "upper_words",
    "symbol_words",
    "log_lines",
    "line_words",
    "distinct_lines",
    "long_word",
)
_CLASSES = np.full(256, 5)
_CLASSES[ord("A") : ord("Z") + 1] = 0
_CLASSES[ord("a") : ord("z") + 1] = 1
_CLASSES[ord("0") : ord("9") + 1] = 2
_CLASSES[[9, 10, 11, 12, 13, 32]] = 3
_CLASSES[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASSES[128:] = 6
_SYMBOL = re.compile("[^\\w\\s.,;:!?'\"()-]")


def text_statistics(text: str) -> tuple[float, ...]:
    """The statistics of one text, in the order of `STATISTICS`."""
    words = text.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    kinds = np.bincount(_CLASSES, weights=np.bincount(data, minlength=256), minlength=7) / len(data)
    often = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    count = len(words)
    return (
        math.log1p(len(text)),
        math.log1p(count),
        sum(map(len, words)) / count,
        kinds[0],
        kinds[2],
        kinds[3],
        kinds[4],
        kinds[5],
        kinds[6],
        sum(len(set(words[i : i + BLOCK_WORDS])) for i in range(0, count, BLOCK_WORDS)) / count,
        max(often.values()) / count,
        sum(map(operator.eq, words, words[1:])) / count,
        sum(n for word, n in often.items() if len(word) > 1 and word.isupper()) / count,
        sum(n for word, n in often.items() if _SYMBOL.search(word)) / count,
        math.log1p(len(lines)),
        count / len(lines),
        len(set(lines)) / len(lines),
        math.log1p(max(map(len, often))),
    )


def statistics(text: Column) -> Column:
    """A struct of the statistics of a text column."""

    # Made here, since a type is read by a running session.
    @F.pandas_udf(", ".join(f"{name} double" for name in STATISTICS))
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_statistics(one) for one in texts], columns=list(STATISTICS), dtype="float64")

    return measured(F.coalesce(text, F.lit("")))


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``(statistic, at most, bound)``; not at most means greater."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self, of: str) -> Column:
        held = F.lit(True)
        for name, at_most, bound in self.conditions:
            value = F.col(f"{of}.{name}")
            held = held & ((value <= bound) if at_most else (value > bound))
        return held.cast("double")


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules and an intercept, on the scale of log odds."""

    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self, of: str) -> Column:
        """The probability of label 1, over a struct column of statistics."""
        odds = F.lit(self.intercept)
        for rule, weight in self.rules:
            odds = odds + rule.column(of) * weight
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


_SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_rules(description: str) -> list[Rule]:
    """The paths to all nodes below the root, of a tree as Spark spells it out."""
    found, path = [], []
    for line in description.splitlines():
        if match := _SPLIT.match(line):
            depth = len(match[1])
            path = [(d, c) for d, c in path if d < depth]
            path.append((depth, (STATISTICS[int(match[3])], match[4] == "<=", float(match[5]))))
            found.append(Rule(tuple(sorted({c for _, c in path}))))
    return found


def fit(examples: DataFrame) -> RuleEnsemble:
    """Fits rules and weights on rows of ``stats`` (a struct of statistics) and ``label`` (0 or 1)."""
    total, ones = examples.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < total:
        share = min(max((ones / total) if total else 0.5, 1e-6), 1 - 1e-6)
        return RuleEnsemble((), math.log(share / (1 - share)))
    values = F.array(*[F.col(f"stats.{name}") for name in STATISTICS])
    rows = examples.select("stats", array_to_vector(values).alias("features"), F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(rows)
    rules = sorted({rule for tree in forest.trees for rule in tree_rules(tree.toDebugString)}, key=lambda r: r.conditions)
    fired = rows.select(array_to_vector(F.array(*[rule.column("stats") for rule in rules])).alias("features"), "label")
    lasso = LogisticRegression(regParam=PENALTY, elasticNetParam=1.0, maxIter=STEPS, standardization=False).fit(fired)
    weights = lasso.coefficients.toArray()
    kept = tuple((rule, float(w)) for rule, w in zip(rules, weights, strict=True) if w)
    return RuleEnsemble(kept, float(lasso.intercept))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def chosen_labels(labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """``doc_id`` and ``label`` of at most about ``most_rows`` labelled documents, chosen by a hash, without those held out."""
    wanted = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    )
    share = most_rows / max(1, wanted.count())
    if share < 1:
        wanted = wanted.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return wanted


def fit_stored(examples: DataFrame) -> RuleEnsemble:
    """`fit` over a stored copy of the rows, which are read many times."""
    path = f"{work_folder(examples.sparkSession)}/examples"
    examples.write.parquet(path)
    return fit(examples.sparkSession.read.schema(examples.schema).parquet(path))


def train(measured: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> RuleEnsemble:
    """Learns ``labels.quality`` from rows of ``doc_id`` and ``stats``, without those held out."""
    wanted = chosen_labels(labels, most_rows)
    return fit_stored(measured.select("doc_id", "stats").join(wanted, "doc_id").select("stats", "label"))


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``stats`` of every row, written to the work folder."""
    spark = docs.sparkSession
    path = f"{work_folder(spark)}/measured"
    measured = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), statistics(F.col("text")).alias("stats"))
    measured.write.parquet(path)
    return spark.read.schema(measured.schema).parquet(path)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    measured = measure(docs)
    scored = measured.withColumn("score", train(measured, labels).score("stats"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score below ``least``."""
    # The chosen labels are `MOST_ROWS` small rows at most, so they go to the documents, and only theirs are measured to learn from.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    labelled = texts.join(F.broadcast(chosen_labels(labels)), "doc_id")
    model = fit_stored(labelled.select(statistics(labelled["text"]).alias("stats"), "label"))
    names = [docs[c] for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), statistics(docs["text"]).alias("stats"))
    return rows.where(model.score("stats") >= least).select("row.*")
