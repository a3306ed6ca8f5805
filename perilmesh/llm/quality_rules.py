"""Quality of documents by a sparse ensemble of rules over text statistics.

Statistics are Column expressions over the whole text.  A random forest of shallow trees is
grown over them; every path from a root to a node below it is a conjunctive rule
(``a <= x AND b > y``).  A lasso logistic regression over the rules' 0/1 columns keeps
few of them, and what it keeps is compiled into one Column expression.  So scoring is a
projection inside Spark's own code: no Python runs over documents, nothing is shuffled.
Forest and lasso are Spark's own; they see one small row of numbers per labelled document.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, small_rows, staged

#: Java patterns of characters other than lower-case letters and white space; each statistic is such characters' share of the text.
CHARACTER_SHARES = {
    "upper_share": r"\p{Lu}+",
    "digit_share": r"\p{Nd}+",
    "loud_share": "[!?]+",
    "stop_share": "[.,;:]+",
    "table_share": r"\|+",
    "symbol_share": r"[^\p{L}\p{M}\p{N}.,;:!?'\"()|-]+",
}
STATISTICS = ("log_words", "word_length", "repeat_share", "distinct_root", "lines_per_word", "soft_share", *CHARACTER_SHARES)


def with_statistics(docs: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """``docs`` (with text) and a column for each of STATISTICS (called by ``names``) of the whole text; of a null or empty one all are 0.

    ``repeat_share`` is the share of words equal to the word before, ``distinct_root`` the
    distinct words over the root of all words (which grows slowly for prose of any length), ``soft_share`` the share
    of letters that aren't upper-case, and of marks.
    """
    names = names or {n: n for n in STATISTICS}
    words, solid, hard = free_names(docs, "_words", "_solid", "_hard")
    text, length = F.coalesce("text", F.lit("")), F.length
    own, n_chars = F.col(words), F.greatest(length(text), F.lit(1))
    n_words = F.greatest(F.size(own), F.lit(1))
    of = {
        "log_words": F.log1p(F.size(own)),
        "word_length": length(solid) / n_words,
        "repeat_share": F.size(F.filter(own, lambda w, i: (i > 0) & (w == F.get(own, i - 1)))) / n_words,
        "distinct_root": F.size(F.array_distinct(own)) / F.sqrt(n_words),
        "lines_per_word": (length(text) - length(F.replace(text, F.lit("\n"))) + F.when(length(text) > 0, 1).otherwise(0)) / n_words,
        "soft_share": (length(solid) - length(hard)) / n_chars,
    }
    of |= {name: (length(hard) - length(F.regexp_replace(hard, pattern, ""))) / n_chars for name, pattern in CHARACTER_SHARES.items()}
    # the words are a column of their own, as the lambda would compute an expression anew for each word; each text without what is
    # counted already is one too, so that most patterns run over a small rest of the text
    split = docs.withColumns({words: F.filter(F.split(text, r"\s+"), lambda w: w != ""), solid: F.regexp_replace(text, r"\s+", "")})
    split = split.withColumn(hard, F.regexp_replace(solid, r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+", ""))
    return split.withColumns({names[n]: of[n].cast("double") for n in STATISTICS}).drop(words, solid, hard)


@dataclass(frozen=True, order=True)
class Rule:
    """A conjunction of bounds: (statistic, low, high) each mean low < statistic <= high; None is no bound."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low is not None:
                out = out & (of[name] > low)
            if high is not None:
                out = out & (of[name] <= high)
        return out

    def with_bound(self, name: str, low: float | None, high: float | None) -> "Rule":
        """This rule and one bound more; of two bounds on a side the tighter one stays."""
        held = {n: (a, b) for n, a, b in self.bounds}
        a, b = held.get(name, (None, None))
        held[name] = (low if a is None else a if low is None else max(a, low), high if b is None else b if high is None else min(b, high))
        return Rule(tuple(sorted((n, a, b) for n, (a, b) in held.items())))

    def __str__(self) -> str:
        sides = [(f"{n} > {low!r}" if low is not None else "", f"{n} <= {high!r}" if high is not None else "") for n, low, high in self.bounds]
        return " AND ".join(s for pair in sides for s in pair if s)


@dataclass
class RuleEnsemble:
    """score = logistic(bias + sum of the weights of the rules that hold)."""

    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0

    def column(self, of: dict[str, Column]) -> Column:
        """The score as one expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(rule.column(of), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def tree_rules(forest) -> list[Rule]:
    """The distinct rules of all paths below the roots of a fitted forest's trees."""
    found: set[Rule] = set()

    def walk(node, rule: Rule) -> None:
        if rule.bounds:
            found.add(rule)
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            name, at = STATISTICS[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), rule.with_bound(name, None, at))
            walk(node.rightChild(), rule.with_bound(name, at, None))

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), Rule(()))
    return sorted(found, key=str)


def fit_rules(rows: DataFrame, *, trees: int = 16, depth: int = 3, lasso: float = 0.002, least_support: float = 0.004, iterations: int = 40, seed: int = 11) -> RuleEnsemble:
    """An ensemble from ``rows`` of (label 0.0 or 1.0, the statistics).

    ``trees`` and ``depth`` bound the rules to trees * (2 ** (depth + 1) - 2); a path is cut where fewer than
    ``least_support`` of the rows would be below it.  Without rows the score is one half
    everywhere; with one label only, or no rule, it is the (smoothed) share of label 1.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    ones = ones or 0
    flat = RuleEnsemble(bias=math.log((ones + 1) / (n - ones + 1)))
    if not 0 < ones < n:
        return flat
    held = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    grower = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", subsamplingRate=0.7, maxBins=64, minInstancesPerNode=max(1, int(n * least_support)))
    rules = tree_rules(grower.fit(held))
    if not rules:
        return flat
    of = {name: F.col(name) for name in STATISTICS}
    matrix = rows.select("label", array_to_vector(F.array(*(r.column(of).cast("double") for r in rules))).alias("features"))
    fitted = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=iterations, tol=1e-4).fit(matrix)
    chosen = [(r, float(w)) for r, w in zip(rules, fitted.coefficients.toArray()) if abs(w) > 1e-6]
    return RuleEnsemble([r for r, _ in chosen], [w for _, w in chosen], float(fitted.intercept))


def fit_quality(docs: DataFrame, labels: DataFrame, *, sample: int = 4000, held_out: Column | None = None, **how) -> RuleEnsemble:
    """Fit on documents with a quality label for which ``held_out`` (an expression over doc_id) isn't true.

    Of each label about ``sample`` documents are drawn by hash of the doc_id (all, if there are
    fewer); this parameter bounds the ids that are sent to all tasks to pick those texts (so no text is shuffled) and the rows of
    statistics that training sees, which are kept in one partition in the order of doc_id so that reruns agree.  Texts are whole.  Several labels of a document count as 1 if
    most are 1; a null label is none; rows without a doc_id aren't trained on.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    if held_out is not None:
        known = known.where(~held_out)
    known = known.groupBy("doc_id").agg((F.avg((F.col("quality") != 0).cast("int")) > 0.5).cast("double").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id"), 11).cast("double") * F.lit(2.0**-53)
    share = F.when(F.col("label") == 1, F.lit(sample / max(1, counts.get(1.0, 0)))).otherwise(F.lit(sample / max(1, counts.get(0.0, 0))))
    ids = small_rows(known.where(draw < share).select("doc_id", "label"), 4 * sample)
    if ids is None:
        raise ValueError("the hash drew far more documents than asked for")
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, label double")
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).select("doc_id", "label", *STATISTICS)
    rows = staged(rows.repartition(1).sortWithinPartitions("doc_id", *STATISTICS), "quality-rows").drop("doc_id")
    rows.persist()
    try:
        return fit_rules(rows, **how)
    finally:
        rows.unpersist()


def score_quality(docs: DataFrame, model: RuleEnsemble, *, threshold: float = 0.3) -> DataFrame:
    """``docs`` (with text) and quality_score (0 to 1) and quality_predicted (1 if the score is at least ``threshold``).

    Null and empty texts score by their statistics, which are all 0.  Columns of these two names are
    replaced; columns of any other name stay.
    """
    docs = docs.drop("quality_score", "quality_predicted")
    held = dict(zip(STATISTICS, free_names(docs, *(f"_{n}" for n in STATISTICS))))
    found = with_statistics(docs, held)
    score = model.column({n: F.col(c) for n, c in held.items()})
    return found.withColumn("quality_score", score).drop(*held.values()).withColumn("quality_predicted", (F.col("quality_score") >= threshold).cast("int"))
