"""Quality by a sparse ensemble of rules.

Trees over statistics of a text are grown by Spark on all labelled rows; every path from a root to a node is a rule, a
conjunction of bounds. A logistic regression under a lasso weighs the rules and leaves few of them, and these are compiled into
one Spark expression, so that scoring is a projection without a model object, a user function or a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import Work, table, words
from chronoweave.llm.quality import measures

#: Statistics that rules are about: ratios of counts, 0 where the divisor is.
STATISTICS = {
    "words": "n_words",
    "lines": "n_lines",
    "word_length": "word_chars / n_words",
    "line_words": "n_words / n_lines",
    "symbols": "n_symbols / n_words",
    "stop_words": "n_stop_words / n_words",
    "duplicate_lines": "n_dup_lines / n_lines",
    "ellipsis_lines": "n_ellipsis_lines / n_lines",
    "bullet_lines": "n_bullet_lines / n_lines",
    "repeated_words": "n_repeat_words / n_words",
    "distinct_words": "n_distinct / n_words",
    "words_again": "n_again / n_words",
    "capital_words": "n_capital / n_words",
    "bare_words": "n_bare / n_words",
    "marks": "n_marks / n_chars",
    "digits": "n_digits / n_chars",
    "sentence_words": "n_words / n_ends",
}


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key (as `key`) and the statistics of each whole text; those of null and empty texts are 0."""
    own = measures(docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")))
    w, t = F.col("w"), F.col("text")
    left = lambda marks: F.length(t) - F.length(F.translate(t, marks, ""))
    own = own.withColumn("w", words(t)).withColumns({
        "n_chars": F.length(t),
        "n_distinct": F.size(F.array_distinct(w)),
        "n_again": F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))),
        "n_capital": F.size(F.filter(w, lambda x: (F.length(x) > 1) & (x == F.upper(x)) & (x != F.lower(x)))),
        "n_bare": F.size(F.filter(w, lambda x: F.upper(x) == F.lower(x))),
        "n_marks": left("!?.,;:|*#$%&<>(){}[]\"'"),
        "n_digits": left("0123456789"),
        "n_ends": left(".!?"),
    })
    return own.select("key", *[F.coalesce(F.expr(_ratio(e)), F.lit(0.0)).cast("double").alias(n) for n, e in STATISTICS.items()])


def _ratio(e: str) -> str:
    top, _, under = e.partition(" / ")
    return f"try_divide({top}, {under})" if under else top


class Bound(NamedTuple):
    statistic: str
    above: bool
    at: float

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c > self.at if self.above else c <= self.at


#: All of its bounds hold.
Rule = tuple[Bound, ...]


def _rule(path: list[Bound]) -> Rule:
    """A path with one bound a statistic and side, the tightest, in a fixed order."""
    tight: dict[tuple[str, bool], float] = {}
    for s, above, at in path:
        k = (s, above)
        tight[k] = at if k not in tight else max(tight[k], at) if above else min(tight[k], at)
    return tuple(sorted(Bound(*k, at) for k, at in tight.items()))


def condition(rule: Rule) -> Column:
    out = rule[0].column()
    for b in rule[1:]:
        out = out & b.column()
    return out


@dataclass(frozen=True)
class Settings:
    trees: int = 24
    depth: int = 3
    #: Labelled rows of a node at least, as a share of all.
    node_share: float = 0.002
    #: Weight of the lasso.
    penalty: float = 0.001
    seed: int = 11


def tree_rules(rows: DataFrame, s: Settings = Settings()) -> list[Rule]:
    """Rules of all nodes but the roots of a forest. rows: label (0.0 or 1.0) and the statistics."""
    names = list(STATISTICS)
    forest = RandomForestClassifier(
        numTrees=s.trees, maxDepth=s.depth, seed=s.seed, bootstrap=False, featureSubsetStrategy="onethird", minWeightFractionPerNode=min(s.node_share, 0.49), maxBins=64
    )
    model = forest.fit(rows.select("label", array_to_vector(F.array(*names)).alias("features")))
    found: set[Rule] = set()
    for tree in model.trees:
        todo = [(tree._call_java("rootNode"), [])]
        while todo:
            node, path = todo.pop()
            if path:
                found.add(_rule(path))
            if node.subtreeDepth():
                split = node.split()
                bound = (names[split.featureIndex()], split.threshold())
                todo += [(node.leftChild(), [*path, Bound(bound[0], False, bound[1])]), (node.rightChild(), [*path, Bound(bound[0], True, bound[1])])]
    return sorted(found)


@dataclass(frozen=True)
class Ensemble:
    """Weights in log odds, by rule, and the log odds where no rule holds."""

    weights: dict[Rule, float]
    base: float

    def column(self) -> Column:
        """The score from the statistics' columns."""
        odds = F.lit(self.base)
        for rule, weight in self.weights.items():
            odds = odds + F.when(condition(rule), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(stats: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Ensemble:
    """stats: of `statistics`; labels: key and label (0 or 1, others teach nothing), each key once.

    Every labelled row teaches, on the executors. Rows that repeat a key teach each. Null keys and labels teach nothing. With
    labels of one class alone there are no rules, and the score is the share of 1 with one row of each class added; without
    labels it is 0.5.
    """
    work = Work(stats.sparkSession, "rules")
    rows = work.write(stats.join(labels.where(F.col("label").isin(0, 1)).select("key", F.col("label").cast("double")), "key").drop("key"))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        rate = (ones + 1) / (n + 2)
        return Ensemble({}, _log_odds(rate))
    rules = tree_rules(rows, s)
    if not rules:
        return Ensemble({}, _log_odds(ones / n))
    holds = array_to_vector(F.array(*[F.when(condition(r), 1.0).otherwise(0.0) for r in rules]))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=s.penalty, maxIter=60, tol=1e-6)
    model = lasso.fit(rows.select("label", holds.alias("features")))
    weights = {r: float(w) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if abs(w) > 1e-9}
    work.close()
    return Ensemble(weights, float(model.intercept))


def _log_odds(p: float) -> float:
    from math import log

    return log(p / (1 - p))


def quality_scores(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Key and score in [0, 1] of each row: what the rules learnt from labels say of its text's statistics.

    Whole texts of any length count; null and empty ones have statistics of 0 and a score as any other. Rows are scored one by
    one, so repeated rows score alike and an empty table gives no rows. A key with several labels has the greatest. Other
    columns of docs and labels are left out.
    """
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label")).where(F.col("key").isNotNull() & F.col("label").isNotNull())
    work = Work(docs.sparkSession, "quality")
    stats = work.write(statistics(docs, key, text))
    ensemble = fit(stats, known.groupBy("key").agg(F.max("label").alias("label")), s)
    return stats.select(F.col("key").alias(key), ensemble.column().alias("score"))


def held_out(key: Column) -> Column:
    """A null id has no fold and isn't held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4, F.lit(0)) == 2


def op12_rule_ensemble_quality(spark, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    scored = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
