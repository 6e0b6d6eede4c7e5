"""Train, cross-validate and tune passage classifiers."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsift.functions.text import mask_numbers
from leafsift.operators import linear, naive_bayes
from leafsift.operators.evaluate import classification_scores
from leafsift.operators.sampling import balance_classes, stratified_folds
from leafsift.session import materialise

# The settings tried by the grid search.
SVC_C = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]
SGD_ALPHA = [1e-3, 1e-2, 1e-1, 1.0, 10.0]
NB_ALPHA = [1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0]
NGRAM_HIGHS = [1, 2, 3]

RATIOS = {True: 1, "1:3": 3}


def prepare(
    labelled: DataFrame, ident: str, balance: bool | str = False, replace_nums: bool = False, mask_years: bool = True
) -> DataFrame:
    """Balance classes and mask numbers as asked."""
    if balance:
        labelled = balance_classes(labelled, F.col(ident), RATIOS[balance])
    if replace_nums:
        labelled = labelled.withColumn("text", mask_numbers("text", years=mask_years))
    return labelled


def train_classifier(labelled: DataFrame, classifier: str = "LinearSVC", ngram_range=(1, 1), C: float = 1.0, alpha: float = 1.0):
    """A model of all rows: vocabulary and totals for MultinomialNB, a ``LinearModel`` otherwise."""
    if not isinstance(labelled, DataFrame):
        raise ValueError("labelled passages must be a DataFrame with the columns text and class")
    if classifier == "MultinomialNB":
        return naive_bayes.train(labelled, alpha, ngram_range)
    return linear.train_linear(labelled, classifier, C=C, alpha=alpha, ngram_range=ngram_range)


def cross_validated(
    labelled: DataFrame,
    ident: str,
    classifier: str = "LinearSVC",
    ngram_range=(1, 1),
    C: float = 1.0,
    alpha: float = 1.0,
    balance: bool | str = False,
    replace_nums: bool = False,
    k: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions and their scores."""
    folded = stratified_folds(
        prepare(labelled, ident, balance, replace_nums).select(ident, "text", "class"), F.col(ident), k
    )
    if classifier == "MultinomialNB":
        predicted = naive_bayes.cross_validate(folded, ident, [alpha], ngram_range, k).drop("alpha")
    else:
        setting = (classifier, C if classifier == "LinearSVC" else alpha)
        predicted = linear.cross_validate_linear(folded, ident, [setting], k, ngram_range).drop("classifier", "value")
    return predicted, classification_scores(predicted)


def grid_search_nb(
    labelled: DataFrame, ident: str, alphas: Sequence[float] = NB_ALPHA, highs: Sequence[int] = NGRAM_HIGHS, k: int = 5
) -> DataFrame:
    """``classifier, ngram_high, value, f1`` (mean over folds) for naive Bayes; all alphas in one job per n-gram range."""
    # Read once for each n-gram range.
    folded = materialise(stratified_folds(labelled.select(ident, "text", "class"), F.col(ident), k))
    parts = []
    for high in highs:
        predicted = naive_bayes.cross_validate(folded, ident, alphas, (1, high), k)
        scores = classification_scores(predicted, ["alpha", "fold"])
        parts.append(
            scores.groupBy(F.col("alpha").alias("value"))
            .agg(F.avg("f1").alias("f1"))
            .select(F.lit("MultinomialNB").alias("classifier"), F.lit(high).alias("ngram_high"), "value", "f1")
        )
    return reduce(DataFrame.unionByName, parts)


def grid_search_linear(
    labelled: DataFrame, ident: str, settings: Sequence[tuple[str, float]], highs: Sequence[int] = NGRAM_HIGHS, k: int = 5
) -> DataFrame:
    """The same for ``(classifier, C or alpha)`` settings; all settings and folds share the rounds of an n-gram range."""
    # Read once for each n-gram range.
    folded = materialise(stratified_folds(labelled.select(ident, "text", "class"), F.col(ident), k))
    parts = []
    # The ranges know nothing of each other, so their rounds run side by side.
    with ThreadPoolExecutor(len(highs)) as pool:
        runs = list(pool.map(lambda high: linear.cross_validate_linear(folded, ident, settings, k, (1, high)), highs))
    for high, predicted in zip(highs, runs):
        scores = classification_scores(predicted, ["classifier", "value", "fold"])
        parts.append(scores.groupBy("classifier", "value").agg(F.avg("f1").alias("f1")).select(
            "classifier", F.lit(high).alias("ngram_high"), "value", "f1"))
    return reduce(DataFrame.unionByName, parts)


def grid_search(labelled: DataFrame, ident: str, balance: bool | str = False, replace_nums: bool = False) -> DataFrame:
    """All settings of all three classifiers; ``orderBy(desc("f1"))`` gives the best."""
    rows = materialise(prepare(labelled, ident, balance, replace_nums, mask_years=False).select(ident, "text", "class"))
    settings = [("LinearSVC", c) for c in SVC_C] + [("SGDClassifier", a) for a in SGD_ALPHA]
    return grid_search_linear(rows, ident, settings).unionByName(grid_search_nb(rows, ident))
