"""From flagged passages to one answer per report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsift.functions.distributed import rank_rows, shuffled_join

REPORT = ["filename", "name", "year", "metric"]


def report_classes(flagged: DataFrame) -> DataFrame:
    """``filename, name, year, metric, class``: is any passage of the report positive?"""
    return flagged.groupBy(*REPORT).agg(F.max("predicted_text_class").cast("int").alias("class"))


def positive_passages(flagged: DataFrame) -> DataFrame:
    """The positive passages, one row each."""
    return flagged.filter(F.col("predicted_text_class") == 1).select(
        *REPORT, "page", "paragraph", F.col("page").alias("predicted_page"), F.col("text").alias("predicted_text")
    )


def collect_passages(flagged: DataFrame) -> DataFrame:
    """Reports with positive passages: parallel lists of pages and texts in document order, one row each.

    A row holds all passages of its report; ``positive_passages`` is the form
    for reports too large for that, ``collect_parts`` one between.
    """
    return _lists(positive_passages(flagged), REPORT, ["page", "paragraph"])


def collect_parts(flagged: DataFrame, per_part: int) -> DataFrame:
    """The same lists cut into rows of at most ``per_part`` passages, numbered by ``part`` from 0."""
    placed = rank_rows(
        positive_passages(flagged)
        .withColumn("_pages", F.floor(F.col("page") / 1024))
        .withColumn("_paras", F.floor(F.col("paragraph") / 1024)),
        REPORT,
        [["_pages"], ["page", "_paras"]],
        ["page", "paragraph"],
        "_at",
    ).withColumn("part", F.floor((F.col("_at") - 1) / per_part).cast("int"))
    return _lists(placed, [*REPORT, "part"], ["_at"])


def _lists(passages: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    lists = passages.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*order, "predicted_page", "predicted_text"))).alias("_p")
    )
    return lists.select(
        *REPORT,
        F.lit(1).alias("class"),
        *keys[len(REPORT) :],
        F.transform("_p", lambda p: p["predicted_page"]).alias("predicted_page"),
        F.transform("_p", lambda p: p["predicted_text"]).alias("predicted_text"),
    )


def assemble(reports: DataFrame, flagged: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per report and metric with class and lists; class 0 and empty lists where nothing was found."""
    asked = reports.select(
        "filename", "name", "year", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric")
    )
    found = collect_passages(flagged).drop("name", "year")
    joined = shuffled_join(asked, found, ["filename", "metric"], "left")
    return joined.select(
        *REPORT,
        F.coalesce("class", F.lit(0)).alias("class"),
        F.coalesce("predicted_page", F.array().cast("array<int>")).alias("predicted_page"),
        F.coalesce("predicted_text", F.array().cast("array<string>")).alias("predicted_text"),
    )
