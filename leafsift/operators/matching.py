"""Match tables: blocks on selected pages with the first match of a metric's patterns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.functions.distributed import fixed_columns, salted_semi_join
from leafsift.operators.automaton import with_matches
from leafsift.operators.patterns import quick_regex, token_patterns
from leafsift.operators.selection import PAGE, block_notes, noted_hits
from leafsift.plans.registry import Metric, get_metric
from leafsift.session import materialise
from leafsift.sources.reports import report_name, report_year


def _marked(
    blocks: DataFrame, metrics: Sequence[Metric], annotator: Callable[[Column], Column] | None
) -> tuple[DataFrame, list[tuple[list[Any], str]], list[list[str]]]:
    """Blocks with ``_of``, the text (or its annotated tokens) where a pattern may match; the sets of patterns and whose they are.

    Blocks that cannot match any metric by a plain regex are not read. Metrics with the same patterns share a set.
    """
    sets: list[tuple[list[Any], str]] = []
    names: list[list[str]] = []
    for m in metrics:
        if (m.patterns, m.kind) not in sets:
            sets.append((m.patterns, m.kind))
            names.append([])
        names[sets.index((m.patterns, m.kind))].append(m.name)
    for patterns, kind in sets:
        token_patterns(patterns, kind)
    if annotator is not None:
        return blocks.withColumn("_of", annotator(F.col("text"))), sets, names
    quick = [quick_regex(patterns, kind) for patterns, kind in sets]
    if not all(quick):
        return blocks.withColumn("_of", F.col("text")), sets, names
    anything = F.lower("text").rlike("|".join(f"(?:{q})" for q in dict.fromkeys(quick)))
    return blocks.withColumn("_of", F.when(anything, F.col("text"))), sets, names


def _spans(found: DataFrame, names: list[list[str]]) -> DataFrame:
    """One row per match and metric from the arrays ``_found``."""
    of_set = F.array(*[F.array(*map(F.lit, group)) for group in names])
    placed = found.withColumn("_m", F.explode_outer("_found")).filter(F.col("_m").isNotNull())
    return placed.select(
        *PAGE,
        "paragraph",
        F.explode(F.get(of_set, F.col("_m.set"))).alias("metric"),
        "text",
        F.col("_m.match_string").alias("match_string"),
        F.col("_m.start").alias("start"),
        (F.col("_m.start") + F.col("_m.n")).alias("end"),
    )


def match_blocks(
    blocks: DataFrame,
    metrics: Sequence[str | Metric],
    annotator: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Blocks that match, on whatever page: ``filename, page, paragraph, metric, text, match_string, start, end``."""
    marked, sets, names = _marked(blocks, [get_metric(m) for m in metrics], annotator)
    likely = marked.filter(F.col("_of").isNotNull()).select(*PAGE, "paragraph", "text", "_of")
    return _spans(with_matches(likely, sets, "_of"), names)


def match_table(
    cleaned: DataFrame,
    metrics: str | Metric | Sequence[str | Metric],
    annotator: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Matches on the pages selected for each metric, from cleaned blocks.

    Page selection and matching are both filters, so one pass over the text
    notes keyword hits and matches together. What it leaves (no text but that
    of matches) is written once and joined by page.
    """
    chosen = [get_metric(m) for m in ([metrics] if isinstance(metrics, (str, Metric)) else metrics)]
    keywords = {m.name: m.keywords for m in chosen}
    marked, sets, names = _marked(cleaned, chosen, annotator)
    notes = block_notes(keywords)
    # Only what a pattern may match is read as text; of the other blocks the notes go on, if they can matter.
    likely = fixed_columns(marked, **notes, _read=F.col("_of"))
    if len(notes) == 1:
        likely = likely.filter((F.size("_hits") > 0) | F.col("_read").isNotNull())
    likely = likely.select(*PAGE, "paragraph", *notes, F.when(F.col("_read").isNotNull(), F.col("text")).alias("text"), "_read")
    noted = with_matches(likely, sets, "_read")
    noted = materialise(noted.withColumn("text", F.when(F.size("_found") > 0, F.col("text"))))
    pages = noted_hits(noted, cleaned, keywords)
    selected = salted_semi_join(_spans(noted, names), pages, [*PAGE, "metric"], F.col("paragraph"))
    # Name and year are part of the file name: no join with the reports.
    return selected.select(
        "filename",
        report_name(F.col("filename")).alias("name"),
        report_year(F.col("filename")).alias("year"),
        "metric", "page", "paragraph", "text", "match_string", "start", "end",
    )
