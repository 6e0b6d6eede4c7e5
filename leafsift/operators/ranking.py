"""Pages of a report that most likely hold the metric.

Counts are taken per page before anything is grouped by report, so a report
with very many matches reaches one task only as one row per page and mapper.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsift.functions.distributed import salted_left_join, shuffled_join
from leafsift.plans.registry import BEST_PAGE_LIKELIHOOD


def best_pages(scored: DataFrame, keys: Sequence[str] = ("filename",)) -> DataFrame:
    """The page with the most confident matches per report: ``keys, page, n, likelihood``.

    Ties go to the higher likelihood, then to the lower page. Likelihoods are
    compared to nine places: beyond that they depend on the order of a sum.
    """
    keys = list(keys)
    pages = (
        scored.filter(F.col("likelihood") > BEST_PAGE_LIKELIHOOD)
        .groupBy(*keys, "page")
        .agg(F.count(F.lit(1)).alias("n"), F.max("likelihood").alias("likelihood"))
    )
    rank = F.struct("n", F.round("likelihood", 9), -F.col("page"))
    best = pages.groupBy(*keys).agg(F.max_by(F.struct("page", "n", "likelihood"), rank).alias("b"))
    return best.select(*keys, "b.page", "b.n", "b.likelihood")


def flag_best_page(scored: DataFrame, keys: Sequence[str] = ("filename",)) -> DataFrame:
    """Add ``predicted_text_class``: 1 for confident matches on the best page, else 0."""
    keys = list(keys)
    winners = best_pages(scored, keys).select(*keys, "page", F.lit(1).alias("_win"))
    joined = salted_left_join(scored, winners, [*keys, "page"], F.col("paragraph"))
    flag = F.when(F.col("_win").isNotNull() & (F.col("likelihood") > BEST_PAGE_LIKELIHOOD), 1).otherwise(0)
    return joined.withColumn("predicted_text_class", flag).drop("_win")


def frequent_pages(matches: DataFrame, keys: Sequence[str] = ("filename",)) -> DataFrame:
    """Every page tied for the most matches of its report: ``keys, page, n``."""
    keys = list(keys)
    pages = matches.groupBy(*keys, "page").agg(F.count(F.lit(1)).alias("n"))
    top = pages.groupBy(*keys).agg(F.max("n").alias("n"))
    return shuffled_join(pages, top, [*keys, "n"], "left_semi").select(*keys, "page", "n")


def flag_frequent_pages(matches: DataFrame, keys: Sequence[str] = ("filename",)) -> DataFrame:
    """Add ``predicted_text_class``: 1 for matches on a most frequent page, else 0."""
    keys = list(keys)
    winners = frequent_pages(matches, keys).select(*keys, "page", F.lit(1).alias("_win"))
    joined = salted_left_join(matches, winners, [*keys, "page"], F.col("paragraph"))
    return joined.withColumn("predicted_text_class", F.coalesce("_win", F.lit(0))).drop("_win")
