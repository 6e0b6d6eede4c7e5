"""Metrics over report collections: the whole chain, set at a time."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.operators import categories, naive_bayes, ranking
from leafsift.operators.assembly import assemble
from leafsift.operators.cleaning import clean_blocks
from leafsift.operators.linear import LinearModel
from leafsift.operators.matching import match_table
from leafsift.plans.registry import Metric, get_metric
from leafsift.session import materialise
from leafsift.sources.reports import first_reports, parsed_reports, report_metadata

PASSAGE = ["filename", "metric", "page", "paragraph"]


def report_matches(
    blocks: DataFrame, metrics: Sequence[str | Metric], annotator: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Match table of raw blocks, written once: it is small next to the text, and every scorer reads it again."""
    cleaned = clean_blocks(blocks, table_contents=True, write_tables=True)
    return materialise(match_table(cleaned, metrics, annotator))


def flag_passages(matches: DataFrame, metric: str | Metric, model: Any = None) -> DataFrame:
    """Add ``predicted_text_class`` by the scorer of the metric.

    ``model`` is a naive Bayes model ``(vocabulary, totals, ngram_range)`` or
    a ``LinearModel``; metrics ranked by page counts need none.
    """
    metric = get_metric(metric)
    rows = matches.filter(F.col("metric") == metric.name)
    if metric.scorer == "frequent_page":
        return ranking.flag_frequent_pages(rows, ["filename", "metric"])
    if model is None:
        raise ValueError(f"{metric.name} needs a model")
    if metric.scorer == "category":
        scored = model.predict(rows, PASSAGE)
        return scored.withColumn("predicted_text_class", categories.decide("probability")).withColumn(
            "probability_text_class", categories.rounded("probability")
        )
    if isinstance(model, LinearModel):
        if metric.scorer == "best_page":
            raise ValueError(f"{metric.name} is ranked by likelihood, which needs a naive Bayes model")
        return model.predict(rows, PASSAGE).withColumnRenamed("prediction", "predicted_text_class")
    vocabulary, totals, ngram_range = model
    scored = naive_bayes.score(rows, PASSAGE, vocabulary, totals, ngram_range)
    if metric.scorer == "best_page":
        return ranking.flag_best_page(scored, ["filename", "metric"]).drop("predicted_class")
    return scored.withColumnRenamed("predicted_class", "predicted_text_class")


def assess_metrics(
    blocks: DataFrame,
    metrics: Sequence[str | Metric],
    models: Mapping[str, Any] | None = None,
    annotator: Callable[[Column], Column] | None = None,
    matches: DataFrame | None = None,
) -> DataFrame:
    """One row per report and metric: ``filename, name, year, metric, class, predicted_page, predicted_text``.

    All reports and metrics go through cleaning and matching together, unless
    their match table is already at hand.
    """
    chosen = [get_metric(m) for m in metrics]
    for m in chosen:
        if m.scorer != "frequent_page" and m.name not in (models or {}):
            raise ValueError(f"{m.name} needs a model")
    if matches is None:
        matches = report_matches(blocks, chosen, annotator)
    columns = ["filename", "name", "year", "metric", "page", "paragraph", "text", "predicted_text_class"]
    flagged = [flag_passages(matches, m, (models or {}).get(m.name)).select(*columns) for m in chosen]
    reports = parsed_reports(report_metadata(blocks, "filename"))
    # The flags are read twice below, for ranks and for lists.
    written = materialise(reduce(DataFrame.unionByName, flagged))
    return assemble(reports, written, [m.name for m in chosen])


def assess_metric(blocks: DataFrame, metric: str | Metric, model: Any = None, **options: Any) -> DataFrame:
    """One metric over all reports of a block table."""
    name = get_metric(metric).name
    return assess_metrics(blocks, [metric], {name: model} if model is not None else None, **options).drop("metric")


def assess_report(blocks: DataFrame, filename: str, metric: str | Metric, model: Any = None, **options: Any) -> DataFrame:
    """One metric for one report; the filter reaches the scan of the block table."""
    return assess_metric(blocks.filter(F.col("filename") == filename), metric, model, **options)


def training_candidates(blocks: DataFrame, metric: str | Metric, n_reports: int) -> DataFrame:
    """Match table of the first ``n_reports`` reports, to be labelled by hand."""
    chosen = first_reports(blocks, n_reports)
    return match_table(clean_blocks(chosen, table_contents=True, write_tables=True), metric)
