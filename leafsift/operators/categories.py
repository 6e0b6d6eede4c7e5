"""Two exclusive text categories: gold labels, probabilities, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.plans.registry import CATEGORY_PROBABILITY


def encode_labels(labelled: DataFrame, category: str = "healthcare") -> DataFrame:
    """Add ``cats MAP<STRING, BOOLEAN>`` with the category and its opposite."""
    positive = F.col("class") == 1
    return labelled.withColumn(
        "cats", F.create_map(F.lit(category), positive, F.lit(f"no_{category}"), ~positive)
    )


def label_pairs(scored: DataFrame, category: str = "healthcare", probability: str = "probability") -> DataFrame:
    """Rows ``label, score, gold`` for both labels of each scored, labelled passage."""
    p, positive = F.col(probability), F.col("class") == 1
    both = F.array(
        F.struct(F.lit(category).alias("label"), p.alias("score"), positive.alias("gold")),
        F.struct(F.lit(f"no_{category}").alias("label"), (1 - p).alias("score"), (~positive).alias("gold")),
    )
    return scored.withColumn("_l", F.explode_outer(both)).select("*", "_l.label", "_l.score", "_l.gold").drop("_l")


def decide(probability: Column | str) -> Column:
    """1 where the category is probable enough."""
    p = F.col(probability) if isinstance(probability, str) else probability
    return F.when(p >= CATEGORY_PROBABILITY, 1).otherwise(0)


def rounded(probability: Column | str) -> Column:
    """Probability to three places."""
    p = F.col(probability) if isinstance(probability, str) else probability
    return F.bround(p, 3)
