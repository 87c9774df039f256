"""Quality scores by a sparse rule ensemble.

Statistics of the whole text are Spark columns. A small random forest on labelled documents is taken apart into its
paths, each a conjunction of thresholds on statistics; a logistic regression with an L1 penalty weighs these rules, and
the rules with a weight are compiled into one Spark expression, so that scoring runs no model code.

The model is learned from labelled rows that are not held out: from all of them up to `MAX_ROWS`, beyond it from a
sample of about so many, drawn by a hash of the id; only their texts are measured. Every document is scored.

Defined cases: null and empty texts have all statistics zero and are scored by the same rules; a doc_id labelled more
than once counts with its lowest label, null labels not at all; with labels of one kind or none at all the score is the
smoothed share of good labels, the same for all; repeated rows are scored alike; an empty table gives no rows; other
columns, of whatever names, are no inputs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import carried, checkpointed, id_bucket, small_side, text_or_empty, words_of

HELD_OUT_OF, HELD_OUT = 5, 0
THRESHOLD = 0.3
MAX_ROWS = 20_000
TREES, DEPTH = 16, 3
PENALTY = 0.002
SEED = 11

STATS = (
    "log_chars", "mean_word", "long_word", "short_words", "distinct_words", "symbols", "upper", "digits", "marks",
    "pipes", "stops", "repeated_lines", "line_words",
)


@dataclass(frozen=True)
class Rule:
    #: (statistic, whether at most or above, threshold)
    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        tests = [F.col(f"_q_{s}") <= F.lit(t) if most else F.col(f"_q_{s}") > F.lit(t) for s, most, t in self.conditions]
        return reduce(lambda a, b: a & b, tests)


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """The probability of a good text, over the columns of with_statistics."""
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + F.when(rule.column(), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with a column _q_<name> for each of STATS, in rates that don't grow with the text, but for log_chars. Names
    beginning with _q_ are this function's; rows that may have any are carried as one column."""
    text = text_or_empty(F.col("text"))
    a = docs.withColumns({"_q_text": text, "_q_words": words_of(F.col("text")), "_q_lines": F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")})
    chars, words, lines = F.greatest(F.length("_q_text"), F.lit(1)), F.greatest(F.size("_q_words"), F.lit(1)), F.greatest(F.size("_q_lines"), F.lit(1))
    rate = lambda pattern, of: F.regexp_count(F.col("_q_text"), F.lit(pattern)) / of
    counted = {
        "log_chars": F.log1p(F.length("_q_text").cast("double")),
        "mean_word": F.length("_q_text") / words,
        "long_word": F.size(F.filter("_q_words", lambda w: F.length(w) > 15)) / words,
        "short_words": F.size(F.filter("_q_words", lambda w: F.length(w) <= 3)) / words,
        "distinct_words": F.size(F.array_distinct("_q_words")) / words,
        "symbols": rate(r"[#*$%&<>]", chars),
        "upper": rate(r"\p{Lu}", chars),
        "digits": rate(r"\p{Nd}", chars),
        "marks": rate(r"[!?;:]", words),
        "pipes": rate(r"[|{}\[\]]", words),
        "stops": rate(r"[.,]", words),
        "repeated_lines": 1 - F.size(F.array_distinct("_q_lines")) / lines,
        "line_words": F.log1p((F.size("_q_words") / lines).cast("double")),
    }
    b = a.withColumns({f"_q_{k}": v.cast("double") for k, v in counted.items()}).drop("_q_text", "_q_words", "_q_lines")
    return b.withColumn("_q_repeated_lines", F.greatest(F.col("_q_repeated_lines"), F.lit(0.0)))


def _paths(node, before: tuple = ()) -> list[tuple]:
    """The conditions of every node below the root, as (feature, at most, threshold)."""
    if node.getClass().getSimpleName() == "LeafNode":
        return []
    feature, threshold = node.split().featureIndex(), node.split().threshold()
    left, right = (*before, (feature, True, threshold)), (*before, (feature, False, threshold))
    return [left, right, *_paths(node.leftChild(), left), *_paths(node.rightChild(), right)]


def _tightened(path: tuple) -> tuple[tuple[str, bool, float], ...]:
    least: dict[tuple[int, bool], float] = {}
    for feature, most, threshold in path:
        now = least.get((feature, most))
        least[feature, most] = threshold if now is None else (min if most else max)(now, threshold)
    return tuple((STATS[f], most, t) for (f, most), t in sorted(least.items()))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """label, features and the _q_ statistics of labelled documents that are not held out, about max_rows at most."""
    usable = labels.where(F.col("quality").isin(0, 1) & (id_bucket(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT))
    known = usable.groupBy(F.col("doc_id").alias("_label_id")).agg(F.min("quality").cast("double").alias("label"))
    share = min(1.0, max_rows / max(1, usable.count()))
    drawn = lambda c: F.pmod(F.xxhash64(F.lit(3), c.cast("long")), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))
    # the labelled ids are joined before any text is measured
    sample = docs.where(drawn(F.col("doc_id"))).select(F.col("doc_id").alias("_doc_id"), "text")
    joined = sample.join(small_side(known.where(drawn(F.col("_label_id")))), F.col("_doc_id") == F.col("_label_id"))
    return with_statistics(joined).drop("text").withColumn("features", array_to_vector(F.array(*[f"_q_{s}" for s in STATS])))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> RuleModel:
    rows = checkpointed(training_rows(docs, labels, max_rows))
    count, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < good < count:
        return RuleModel(math.log((good + 1) / (count - good + 1)), ())
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.7, featureSubsetStrategy="onethird", minInstancesPerNode=3, seed=SEED).fit(rows)
    found = sorted({_tightened(p) for tree in forest.trees for p in _paths(tree._java_obj.rootNode())})
    if not found:
        return RuleModel(math.log((good + 1) / (count - good + 1)), ())
    rules = [Rule(conditions) for conditions in found]
    tried = rows.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(regParam=PENALTY, elasticNetParam=1.0, maxIter=60, tol=1e-5).fit(tried)
    weights = lasso.coefficients.toArray().tolist()
    return RuleModel(float(lasso.intercept), tuple(Rule(r.conditions, w) for r, w in zip(rules, weights, strict=True) if w))


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    rows = with_statistics(docs.select("doc_id", "text")).select("doc_id", model.score().alias("score"))
    held_out = id_bucket(F.col("doc_id"), HELD_OUT_OF) == HELD_OUT
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold."""
    model = fit(docs, labels)
    return with_statistics(carried(docs, text=F.col("text"))).where(model.score() >= threshold).select("_row.*")
