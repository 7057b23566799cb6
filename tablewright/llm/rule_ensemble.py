"""Quality classifier: a sparse ensemble of rules taken from trees.

Statistics of the texts are computed in one pass and written. A random forest is fitted on labelled rows,
every path from a root to a node becomes a conjunctive rule, and a lasso logistic regression over the
rule indicators keeps the few that matter. The kept rules are compiled into one Spark column expression,
so that scoring the corpus is a projection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm import bytewords as bw
from tablewright.llm.quality_rules import measure_slice, repeated
from tablewright.llm.streams import bounded_batches
from tablewright.session import materialise

#: labelled rows that are learned from, at most
TRAIN_ROWS = 40_000
TREES = 16
DEPTH = 3
LASSO = 0.002

UPPER = bw.byte_table(range(65, 91))
LOWER = bw.byte_table(range(97, 123))
DIGIT = bw.byte_table(range(48, 58))
MARKS = bw.byte_table(b"!?")
PUNCTUATION = bw.byte_table(b".,;:!?")

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digit",
          "n_marks", "n_punctuation", "n_distinct_words", "n_same_as_last"]


def _ratio(a: str, b: str) -> str:
    return f"if({b} > 0, {a} / {b}, 0D)"


#: statistics as SQL over the counts
STATISTICS = {
    "log_words": "ln(1D + n_words)",
    "word_length": _ratio("word_chars", "n_words"),
    "symbols": _ratio("n_symbols", "word_chars"),
    "upper": _ratio("n_upper", "(n_upper + n_lower)"),
    "digits": _ratio("n_digit", "word_chars"),
    "marks": _ratio("n_marks", "n_words"),
    "punctuation": _ratio("n_punctuation", "n_words"),
    "distinct": _ratio("n_distinct_words", "n_words"),
    "repeats": _ratio("n_repeat_words", "n_words"),
    "stutter": _ratio("n_same_as_last", "n_words"),
    "dup_lines": _ratio("n_dup_lines", "n_lines"),
    "line_words": _ratio("n_words", "n_lines"),
}


def _counts(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    words = bw.runs(data, bounds)
    lines = bw.runs(data, bounds, bw.LINE_BYTES)

    def of(table: np.ndarray) -> np.ndarray:
        return bw.per_text(table[data], bounds)

    hashes, owner = words.hashes(), words.owner()
    _, again = repeated(hashes, owner)
    stutter = np.zeros(len(hashes), bool)
    stutter[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    return [*measure_slice(data, bounds), lines.counts, of(UPPER), of(LOWER), of(DIGIT), of(MARKS), of(PUNCTUATION),
            words.counts - bw.per_text(again, words.first), bw.per_text(stutter, words.first)]


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, the STATISTICS) of every row; a null text is an empty one, and all its ratios are 0."""
    bounded_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in bw.slices(batch, "text"):
                found = [pa.array(np.asarray(x, np.float64)) for x in _counts(data, bounds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *found], names=["doc_id", *COUNTS])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{c} double" for c in COUNTS))
    return counted.select("doc_id", *(F.expr(sql).alias(name) for name, sql in STATISTICS.items()))


@dataclass(frozen=True)
class Rule:
    """A conjunction: for each statistic the open lower and the closed upper bound."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        parts = []
        for name, low, high in self.bounds:
            if low > float("-inf"):
                parts.append(F.col(name) > low)
            if high < float("inf"):
                parts.append(F.col(name) <= high)
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out


@dataclass
class RuleModel:
    """score = logistic(intercept + sum of the weights of the rules that hold)."""

    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


_STEP = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>) ([-+.0-9eE]+)\)")


def tree_rules(description: str, names: list[str]) -> set[Rule]:
    """Every path from a root to another node of the trees, as bounds per statistic."""
    path: list[tuple[int, str, float, float]] = []
    found = set()
    for line in description.splitlines():
        step = _STEP.match(line)
        if not step:
            if line.lstrip().startswith("Tree"):
                path = []
            continue
        indent, name, cut = len(step[1]), names[int(step[3])], float(step[5])
        path = [p for p in path if p[0] < indent]
        path.append((indent, name, float("-inf"), cut) if step[4] == "<=" else (indent, name, cut, float("inf")))
        bounds: dict[str, tuple[float, float]] = {}
        for _, n, low, high in path:
            a, b = bounds.get(n, (float("-inf"), float("inf")))
            bounds[n] = (max(a, low), min(b, high))
        found.add(Rule(tuple(sorted((n, a, b) for n, (a, b) in bounds.items()))))
    return found


def fit_rules(train: DataFrame, label: str = "label", trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 5) -> RuleModel:
    """A rule model for rows with the STATISTICS and a 0/1 ``label``.

    Without rows every score is 0.5; with one class only, it is the share of that class, kept off 0 and 1.
    """
    n, ones = train.agg(F.count("*"), F.sum(label)).first()
    ones = ones or 0
    if not n or ones in (0, n):
        share = (ones + 0.5) / (n + 1)
        return RuleModel(float(np.log(share / (1 - share))))
    names = list(STATISTICS)
    rows = train.select(array_to_vector(F.array(*names)).alias("features"), F.col(label).cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7, featureSubsetStrategy="onethird",
                                    minInstancesPerNode=5, maxBins=64).fit(rows)
    rules = sorted(tree_rules(forest.toDebugString, names), key=lambda r: r.bounds)
    if not rules:
        return RuleModel(float(np.log(ones / (n - ones))))
    indicators = train.select(array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("features"),
                              F.col(label).cast("double").alias("label"))
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(indicators)
    weights = fitted.coefficients.toArray()
    return RuleModel(float(fitted.intercept), [(r, float(w)) for r, w in zip(rules, weights) if w])


def sample_rows(labels: DataFrame, rows: int, doc_id: str = "doc_id") -> DataFrame:
    """At most ``rows`` labelled rows, chosen by a digest of their id."""
    return labels.orderBy(F.xxhash64(F.col(doc_id), F.lit(17)), doc_id).limit(rows)


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
                   train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, score): the probability of label 1 for every row of ``docs``.

    ``labels`` holds the rows to learn from, at most ``train_rows`` of them are used; rows with a null
    label or id are left out, and labels of unknown documents say nothing. Null and empty texts are
    scored as texts without words. Repeated rows are all scored; other columns are ignored.
    """
    known = materialise(statistics(docs, doc_id, text), "statistics")
    chosen = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("label")).where("_id is not null and label is not null")
    chosen = F.broadcast(sample_rows(chosen, train_rows, "_id"))  # bounded by train_rows
    train = materialise(known.join(chosen, F.col("doc_id") == F.col("_id")).select("label", *STATISTICS), "train")
    return known.select("doc_id", fit_rules(train).score().alias("score"))
