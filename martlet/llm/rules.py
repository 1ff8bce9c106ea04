"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on the statistics of labelled documents; every path from a
root to a node is a rule, a conjunction of thresholds.  A logistic model with lasso
weights over the rules keeps a few of them.  These are compiled into one Spark column
expression, so every document is scored inside code generation, from its whole text.

Only the fit is made on a sample: at most `most` labelled rows, those of smallest
hash of the id.  Trees and weights are fitted by Spark ML.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import held_out, stage, words_of

SAMPLE, TREES, DEPTH, LASSO = 20_000, 16, 3, 0.002


def _share(removed: str, text: Column, of: Column) -> Column:
    return (of - F.length(F.regexp_replace(text, removed, ""))) / of


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with the statistics of the text (doubles); without words all are 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))

    def of_words(w: Column) -> Column:
        again = F.filter(w, lambda x, i: x == F.get(w, i - 1))
        return F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("kinds"), F.size(again).alias("again"))

    counted = docs.withColumn("__w", F.get(F.transform(F.array(words_of(text)), of_words), F.lit(0)))
    words, kinds = F.col("__w.words"), F.col("__w.kinds")
    least = F.greatest(words, F.lit(1))
    letters = F.greatest(n - F.length(F.regexp_replace(text, r"\p{L}+", "")), F.lit(1))
    lines = n - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    stats = {
        "log_words": F.log1p(words.cast("double")),
        "distinct": kinds / least,
        "distinct_for_length": kinds / F.sqrt(least.cast("double")),
        "repeats": F.col("__w.again") / least,
        "word_length": n / least,
        "symbols": _share(r"[^\p{L}\p{N}\s.,]+", text, n),
        "stops": _share(r"[.,]+", text, n),
        "bars": _share(r"\|+", text, n),
        "digits": _share(r"[0-9]+", text, n),
        "capitals": _share(r"[A-Z]+", text, n) * n / letters,
        "letters": letters / n,
        "line_words": words / lines,
    }
    for name, value in stats.items():
        counted = counted.withColumn(f"__s_{name}", F.when(words > 0, value.cast("double")).otherwise(F.lit(0.0)))
    return counted.drop("__w")


STATISTICS = ["log_words", "distinct", "distinct_for_length", "repeats", "word_length", "symbols", "stops", "bars", "digits", "capitals", "letters", "line_words"]


@dataclass(frozen=True)
class Rule:
    """All of: statistic <= bound (up) or > bound (not up)."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        held = F.lit(True)
        for name, up, bound in self.terms:
            held = held & ((F.col(f"__s_{name}") <= bound) if up else (F.col(f"__s_{name}") > bound))
        return held

    def text(self) -> str:
        return " and ".join(f"{name} {'<=' if up else '>'} {bound:.6g}" for name, up, bound in self.terms)


def _tightened(terms: list[tuple[str, bool, float]]) -> Rule:
    bounds: dict[tuple[str, bool], float] = {}
    for name, up, bound in terms:
        held = bounds.get((name, up), math.inf if up else -math.inf)
        bounds[name, up] = min(held, bound) if up else max(held, bound)
    return Rule(tuple(sorted((name, up, bound) for (name, up), bound in bounds.items())))


def _paths(node, terms: list) -> list[Rule]:
    """The rules of all nodes below a node of a fitted tree."""
    if node.numDescendants() == 0:
        return []
    split = node.split()
    name, bound = STATISTICS[split.featureIndex()], float(split.threshold())
    found = []
    for child, up in ((node.leftChild(), True), (node.rightChild(), False)):
        own = [*terms, (name, up, bound)]
        found += [_tightened(own), *_paths(child, own)]
    return found


class RuleEnsemble:
    """score = logistic(intercept + sum of the weights of the rules that hold)."""

    def __init__(self, intercept: float, weights: dict[Rule, float]):
        self.intercept, self.weights = intercept, weights

    def score(self) -> Column:
        z = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 7) -> RuleEnsemble:
    """`labelled` has the statistics and label (0.0 or 1.0).  Rows of one class only, or none, give the (smoothed) share of ones as the score of all."""
    rows, ones = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, rows):
        return RuleEnsemble(math.log((ones + 1) / (rows - ones + 1)), {})
    assembled = VectorAssembler(inputCols=[f"__s_{s}" for s in STATISTICS], outputCol="__x").transform(labelled).select("__x", "label")
    forest = RandomForestClassifier(featuresCol="__x", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="sqrt", seed=seed).fit(assembled)
    rules = sorted({rule for tree in forest.trees for rule in _paths(tree._call_java("rootNode"), [])}, key=Rule.text)
    held = labelled.select("label", F.array(*[F.when(r.column(), 1.0).otherwise(0.0) for r in rules]).alias("a"))
    held = held.select("label", array_to_vector("a").alias("__x"))
    model = LogisticRegression(featuresCol="__x", labelCol="label", elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=200).fit(held)
    return RuleEnsemble(float(model.intercept), {r: float(w) for r, w in zip(rules, model.coefficients) if w})


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """Columns of `docs` and label for at most `most` labelled rows outside the held-out fold, those of smallest hash of the id.

    Rows without id or label are left out; an id labelled twice has the larger label.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col(label)).cast("double").alias("label"))
    chosen = stage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("__known"), "label"))
    return docs.join(chosen, docs["doc_id"] == chosen["__known"]).drop("__known")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = SAMPLE) -> DataFrame:
    """The rows of `docs` whose text scores at least `threshold`, all columns as they are.

    Null and blank texts are judged like any other; repeated rows alike.  The text is
    read once for the fit, where it is labelled, and once to score; nothing is shuffled.
    """
    known = training_rows(docs.select("doc_id", "text"), labels, "quality", most)
    labelled = stage(with_statistics(known).drop("doc_id", "text"))
    # A filter on the score alone would be moved below the statistics, which would then be
    # computed again for every term of every rule; the row number keeps it above them.
    scored = with_statistics(docs).withColumn("__score", fit(labelled).score()).withColumn("__row", F.monotonically_increasing_id())
    return scored.filter((F.col("__score") >= threshold) & (F.col("__row") >= 0)).select(*docs.columns)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`, from its text alone.

    Null and blank texts have all statistics 0 and are scored like any other.  Rows
    without id count as not held out.  Repeated rows are scored alike.  Without labels
    every score is 0.5; an empty table gives no rows.
    """
    stats = stage(with_statistics(docs.select("doc_id", "text")).drop("text"))
    labelled = stage(training_rows(stats, labels, "quality", most).drop("doc_id"))
    score = fit(labelled).score()
    return stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
