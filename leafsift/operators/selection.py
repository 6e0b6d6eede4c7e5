"""Pages that mention a metric's keywords.

A page counts when any keyword (a regex) is found in its blocks joined by
spaces, lower-cased. Only page keys are shuffled: text stays where it is read,
unless a keyword can reach from one block into the next.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.functions.distributed import explode_rows, fixed_columns, rank_rows, salted_semi_join
from leafsift.plans.registry import Metric, get_keywords
from leafsift.session import materialise

PAGE = ["filename", "page"]
_PLAIN = re.compile(r"[\w \-]+", re.ASCII)
# Ends a piece of a longer block; plain keywords hold printable characters only.
CUT = "\u0000"


def split_keywords(keywords: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
    """Keywords by how they may match: within a block, across blocks, anywhere (regexes).

    A phrase that contains another keyword of the list as part of one word
    needs no look across blocks: that keyword is then found within a block.
    """
    plain = [k for k in keywords if _PLAIN.fullmatch(k)]
    words = [k for k in plain if " " not in k]
    across = [k for k in plain if " " in k and not any(w in k for w in words)]
    return plain, across, [k for k in keywords if not _PLAIN.fullmatch(k)]


def any_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """Is a keyword found in the lower-cased text? Plain ones are looked up as they are, free ones as one literal regex."""
    low = F.lower(text)
    found = [F.contains(low, F.lit(k)) for k in keywords if _PLAIN.fullmatch(k)]
    free = [f"(?:{k})" for k in keywords if not _PLAIN.fullmatch(k)]
    return reduce(Column.__or__, found + ([low.rlike("|".join(free))] if free else []))


def _across(keywords: Mapping[str, Sequence[str]]) -> list[tuple[list[str], list[str]]]:
    """Phrases that may run over a block end, with the metrics that ask for them."""
    groups = [(names, split_keywords(words)[1]) for words, names in keyword_groups(keywords).items()]
    return [(names, phrases) for names, phrases in groups if phrases]


def block_notes(keywords: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """What one pass over the text notes of a block.

    ``_hits``: the metrics it hits by itself, a list per keyword list. If a phrase
    may run over a block end, also whether the block ends like the front of a
    phrase or begins like the rest, and then its first and last characters. A
    block inside a phrase is a whole word of it, so it does both; one that is
    longer than its piece ends in a mark that no phrase has, and so does a
    block that does neither.
    """
    flags = []
    for words, names in keyword_groups(keywords).items():
        plain, _, _ = split_keywords(words)
        if plain:
            flags.append(F.when(any_keyword(F.col("text"), plain), F.array(*map(F.lit, names))))
    notes = {"_hits": F.array_compact(F.array(*flags)) if flags else F.array().cast("array<array<string>>")}
    phrases = [p for _, own in _across(keywords) for p in own]
    if phrases:
        reach = max(len(p) for p in phrases) - 1
        cuts = [(p[:i], p[i + 1 :]) for p in phrases for i, ch in enumerate(p) if ch == " "]
        text = F.lower("text")
        ending = reduce(Column.__or__, [F.endswith(text, F.lit(w)) for w in sorted({front.split(" ")[-1] for front, _ in cuts})])
        beginning = reduce(Column.__or__, [F.startswith(text, F.lit(w)) for w in sorted({rest.split(" ")[0] for _, rest in cuts})])
        head = F.concat(F.left(text, F.lit(reach)), F.when(F.length(text) > reach, CUT).otherwise(""))
        notes |= {"_ending": ending, "_beginning": beginning, "_head": F.when(ending | beginning, head).otherwise(CUT),
                  "_tail": F.when(ending, F.right(text, F.lit(reach))).otherwise(CUT)}
    return notes


def _hits_across(ends: DataFrame, groups: Sequence[tuple[list[str], list[str]]]) -> DataFrame:
    """Pages where a phrase runs over a block end, from the written notes of all blocks.

    Only pages count with a block that ends like the front of a phrase and one
    that begins like the rest. There, every block joins at most as many short
    neighbourhoods as a phrase has spaces, plus its own.
    """
    steps = max(p.count(" ") for _, phrases in groups for p in phrases)
    likely = (
        ends.filter(F.col("_ending") | F.col("_beginning"))
        .groupBy(*PAGE)
        .agg(F.bool_or("_ending").alias("_ending"), F.bool_or("_beginning").alias("_beginning"))
        .filter("_ending AND _beginning")
        .select(*PAGE)
    )
    few = materialise(salted_semi_join(ends.select(*PAGE, "paragraph", "_head", "_tail"), likely, PAGE, F.col("paragraph")))
    placed = rank_rows(
        few.withColumn("_paras", F.floor(F.col("paragraph") / 1024)), PAGE, [["_paras"]], ["paragraph"], "_at"
    )
    piece = F.struct(
        "_step", F.when(F.col("_step") == 0, F.col("_tail")).otherwise(F.col("_head")).alias("t")
    )
    pieces = placed.select(
        *PAGE,
        F.posexplode(F.array([F.col("_at") - i for i in range(steps + 1)])).alias("_step", "_from"),
        "_head",
        "_tail",
    ).select(*PAGE, "_from", piece.alias("_piece"))
    # At most ``steps + 1`` pieces per group, of at most the longest phrase's length each.
    joined = pieces.groupBy(*PAGE, "_from").agg(F.sort_array(F.collect_list("_piece")).alias("_p"))
    around = joined.withColumn("_around", F.array_join(F.transform("_p", lambda p: p["t"]), " "))
    found = [F.when(any_keyword(F.col("_around"), phrases), F.array(*map(F.lit, names))) for names, phrases in groups]
    named = explode_rows(around, F.array(*found), "_names")
    return named.select(*PAGE, F.explode_outer("_names").alias("metric")).distinct()


def _hits_whole_page(blocks: DataFrame, names: Sequence[str], patterns: Sequence[str]) -> DataFrame:
    """Pages where a free regex is found in the page text; such a regex needs the text as one value."""
    pages = blocks.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("paragraph", "text"))).alias("_b"))
    text = F.array_join(F.transform("_b", lambda b: b["text"]), " ")
    return pages.filter(any_keyword(text, patterns)).select(*PAGE, F.explode_outer(F.array(*map(F.lit, names))).alias("metric"))


def keyword_groups(keywords: Mapping[str, Sequence[str]]) -> dict[tuple[str, ...], list[str]]:
    """Metrics by their keywords: the same list is looked up once."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for name, words in keywords.items():
        groups.setdefault(tuple(words), []).append(name)
    return groups


def noted_hits(noted: DataFrame, blocks: DataFrame, keywords: Mapping[str, Sequence[str]]) -> DataFrame:
    """``filename, page, metric`` from the notes; free regexes look at ``blocks``."""
    named = explode_rows(noted, F.col("_hits"), "_names").select(*PAGE, "_names").distinct()
    hits = named.select(*PAGE, F.explode_outer("_names").alias("metric"))
    groups = _across(keywords)
    if groups:
        hits = hits.unionByName(_hits_across(noted, groups))
    for words, names in keyword_groups(keywords).items():
        _, _, free = split_keywords(words)
        if free:
            hits = hits.unionByName(_hits_whole_page(blocks, names, free))
    return hits.distinct()


def page_hits(blocks: DataFrame, keywords: Mapping[str, Sequence[str]]) -> DataFrame:
    """``filename, page, metric`` for many metrics in one pass over the text."""
    if not any(keywords.values()):
        raise ValueError("no keywords given")
    notes = block_notes(keywords)
    noted = fixed_columns(blocks.select(*PAGE, "paragraph", "text"), **notes).select(*PAGE, "paragraph", *notes)
    # Notes that are read more than once are written: they are short, and the text is read once.
    return noted_hits(materialise(noted) if len(notes) > 1 else noted, blocks, keywords)


def select_pages(blocks: DataFrame, metric: str | list[str] | Metric) -> DataFrame:
    """All blocks of the pages that mention the metric (or any keyword of a list)."""
    hits = page_hits(blocks, {"_": get_keywords(metric)}).drop("metric")
    return salted_semi_join(blocks, hits, PAGE, F.col("paragraph"))


def select_pages_many(blocks: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Page keys selected for each of several metrics: ``filename, page, metric``."""
    return page_hits(blocks, {m: get_keywords(m) for m in metrics})
