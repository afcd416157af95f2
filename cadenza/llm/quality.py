"""Quality by a sparse ensemble of rules, compiled to column expressions.

Statistics of a whole text are made by DataFrame functions.  A forest of shallow trees is grown on
labelled rows; each way from a root to a node is a rule, a conjunction of bounds on statistics.  A logistic
regression with an L1 penalty weighs the rules and drops most of them; what is left is one column
expression, so scoring a table is a projection.

The forest and the weights learn from `SAMPLE` labelled rows at most, those whose ids hash lowest (a
documented bound).  Statistics and scores cover all rows.

Defined results: null and empty texts have all statistics zero and get the score the rules give that.
Rows without a label (or with a null one) are scored alike; a doc_id labelled several times counts once,
by its least label.  With labels of one class, or none, the score is that class, or one half.  A null id is
never learnt from.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import ids_and_texts, labelled_sample, materialized, merged_columns

SAMPLE = 20_000
TREES, DEPTH, LEAST_ROWS = 16, 4, 5
PENALTY = 0.002
SEED = 9


def statistics(text: str = "text") -> dict[str, Column]:
    t = F.col(text)

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(t, pattern, ""))

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return {
        "n_chars": F.length(t).cast("double"),
        "n_words": F.size("words").cast("double"),
        "n_lines": F.size("lines").cast("double"),
        "letters": share(left(r"[^\p{L}]+"), F.length(t)),
        "capitals": share(left(r"[^\p{Lu}]+"), F.length(t)),
        "digits": share(left(r"[^\p{N}]+"), F.length(t)),
        "symbols": share(left(r"[\p{L}\p{N}\s.,;:'\"!?()-]+"), F.length(t)),
        "marks": share(left(r"[^!?]+"), F.length(t)),
        "word_length": share(F.length(F.array_join("words", "")), F.size("words")),
        "different_words": share(F.size(F.array_distinct("words")), F.size("words")),
        "different_lines": share(F.size(F.array_distinct("lines")), F.size("lines")),
        "words_a_line": share(F.size("words"), F.size("lines")),
        "longest_word": F.coalesce(F.array_max(F.transform("words", F.length)), F.lit(0)).cast("double"),
        "short_words": share(F.size(F.filter("words", lambda w: F.length(w) <= 3)), F.size("words")),
    }


FEATURES = [
    "n_chars", "n_words", "n_lines", "letters", "capitals", "digits", "symbols", "marks", "word_length",
    "different_words", "different_lines", "words_a_line", "longest_word", "short_words",
]


def featured(texts: DataFrame, *keep: str) -> DataFrame:
    """The statistics of column `text`, and the columns to keep."""
    split = texts.select(
        *keep, "text", F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)).alias("words"),
        F.when(F.length("text") > 0, F.split("text", "\n", -1)).otherwise(F.array().cast("array<string>")).alias("lines"))
    return split.select(*keep, *[c.alias(n) for n, c in statistics().items()])


Bounds = tuple[tuple[str, float, float], ...]


def paths(forest: str, names: list[str]) -> list[Bounds]:
    """Every way from a root to a node in a printed forest, as bounds low < statistic <= high; each once.

    An If or Else stands one deeper than the condition it hangs on, so indentation tells the way.
    """
    found: dict[Bounds, None] = {}
    way: list[tuple[int, int, str, float]] = []
    for line in forest.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\deE]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        way = [w for w in way if w[0] < depth] + [(depth, int(m[2]), m[3], float(m[4]))]
        bounds: dict[str, tuple[float, float]] = {}
        for _, feature, sign, cut in way:
            low, high = bounds.get(names[feature], (-math.inf, math.inf))
            bounds[names[feature]] = (low, min(high, cut)) if sign == "<=" else (max(low, cut), high)
        found[tuple(sorted((n, a, b) for n, (a, b) in bounds.items()))] = None
    return list(found)


def holds(rule: Bounds) -> Column:
    out = F.lit(True)
    for name, low, high in rule:
        if low > -math.inf:
            out = out & (F.col(name) > low)
        if high < math.inf:
            out = out & (F.col(name) <= high)
    return out


class RuleModel:
    """score = 1 / (1 + exp(-(intercept + sum of the weights of the rules that hold)))."""

    def __init__(self, intercept: float, rules: list[tuple[Bounds, float]]) -> None:
        self.intercept, self.rules = intercept, rules

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, learn_not: Column, label: str = "quality", sample: int = SAMPLE) -> RuleModel:
    """Labels where `learn_not` (of doc_id) holds are not used."""
    # `sample` rows of two numbers at most.
    chosen = F.broadcast(materialized(labelled_sample(labels, label, learn_not, sample), "quality-labels"))
    # One row of each id, that of the least text hash: however often an id stands in the table, `sample` rows are fitted.
    known = ids_and_texts(docs).join(chosen, "doc_id").groupBy("doc_id").agg(
        F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "label")).alias("one")).select("doc_id", "one.text", "one.label")
    examples = featured(known, "doc_id", "label")
    # Dealt and sorted by value, so that a repeated run grows the same trees.
    rows = materialized(
        examples.repartition(4, "doc_id").sortWithinPartitions("doc_id", *FEATURES)
        .select("label", array_to_vector(F.array(*FEATURES)).alias("features"), *FEATURES), "quality-sample")
    seen = rows.agg(F.count("*"), F.sum("label")).first()
    rate = seen[1] / seen[0] if seen[0] else 0.5
    if rate in (0.0, 1.0) or not seen[0]:
        return RuleModel(math.inf if rate == 1 else -math.inf if rate == 0 else 0.0, [])
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_ROWS, featureSubsetStrategy="onethird",
        subsamplingRate=0.7, seed=SEED).fit(rows)
    rules = paths(forest.toDebugString, FEATURES)
    if not rules:
        return RuleModel(math.log(rate / (1 - rate)), [])
    marked = materialized(rows.select("label", array_to_vector(F.array(
        *[holds(r).cast("double") for r in rules])).alias("features")), "quality-rules")
    weights = LogisticRegression(maxIter=60, regParam=PENALTY, elasticNetParam=1.0).fit(marked)
    return RuleModel(weights.intercept, [(r, w) for r, w in zip(rules, weights.coefficients.toArray()) if w != 0])


def quality_scores(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id and score, a row per row of `docs`."""
    return featured(ids_and_texts(docs), "doc_id").select("doc_id", model.score().alias("score"))


def accepted(docs: DataFrame, model: RuleModel, least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose score is `least` or more."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    # Behind a generator the filter stays where it is, and statistics are computed once.
    scored = featured(rows, "row").select("row", F.explode(F.array(model.score())).alias("score"))
    return scored.where(F.col("score") >= least).select(*merged_columns(docs, {}))
