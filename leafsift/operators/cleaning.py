"""Block-level cleaning: audit, table recognition and reduction, junk removal.

Input of every operator is a block table ``filename, page, paragraph, text``
(page and paragraph count from 1). Table blocks are a side branch: only their
reduced words are shuffled, ordinary paragraphs are cleaned where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafsift.functions.distributed import shuffled_join
from leafsift.functions.text import (
    NOT_SPACE,
    NOT_WORD,
    SPACE,
    count_matches,
    is_blank,
    round_significant,
    squash,
    strip,
)
from leafsift.session import materialise

# What marks a table block, and how often.
HARD_BREAK = NOT_SPACE + r"\n(?:\d|" + NOT_WORD + ")"
SOFT_BREAK = SPACE + r"\n[\d\s\x1c-\x1f]"
HARD_BREAKS_NEEDED = 4
SOFT_BREAKS_NEEDED = 3

# A block holding one of these is dropped.
JUNK_MARKERS = ("<image:", ".indd", "\ufffd", "\uf0b7", "\u2013")

# Pages and paragraphs per cell of the distributed table numbering.
PAGES_PER_CELL = 1024
PARAGRAPHS_PER_CELL = 1024


def count_characters(blocks: DataFrame, pattern: str) -> DataFrame:
    """Matches of a regex over all blocks of each report: ``filename, n``."""
    return blocks.groupBy("filename").agg(
        F.sum(count_matches("text", pattern)).cast("bigint").alias("n")
    )


def audit_characters(blocks: DataFrame) -> DataFrame:
    """Unreadable characters per report: counts, percentage, and a two-digit form for people."""
    counted = blocks.groupBy("filename").agg(
        F.sum(count_matches("text", "\ufffd")).cast("bigint").alias("n_bad"),
        F.sum(count_matches("text", "[^ ]")).cast("bigint").alias("n_chars"),
    )
    share = F.try_divide(F.lit(100.0) * F.col("n_bad"), F.col("n_chars"))
    return counted.withColumn("pct_bad", share).withColumn(
        "pct_bad_short", round_significant("pct_bad", 2)
    )


def is_table(text: Column | str = "text") -> Column:
    """Does the block look like (part of) a table?"""
    # Every hit takes a line feed, which most paragraphs have too few of.
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (feeds >= min(HARD_BREAKS_NEEDED, SOFT_BREAKS_NEEDED)) & (
        (count_matches(text, HARD_BREAK) >= HARD_BREAKS_NEEDED) | (count_matches(text, SOFT_BREAK) >= SOFT_BREAKS_NEEDED)
    )


def word_entries(text: Column | str = "text") -> Column:
    """The lines of a table that start with an ASCII letter, in order."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(text, "\n"), lambda line: line.rlike("^[a-zA-Z]"))


def table_words(text: Column | str = "text") -> Column:
    """A table reduced to its words."""
    return strip(F.array_join(word_entries(text), " "))


def number_tables(tables: DataFrame) -> DataFrame:
    """Add ``table_no``, ``joined_no`` and ``n_joined`` to table blocks.

    ``table_no`` numbers the blocks of a report; ``joined_no`` numbers the
    stitched tables (runs of adjacent paragraphs of one page) and ``n_joined``
    counts them. Cells of at most 1,024 paragraphs are numbered on their own
    and shifted by the counts of the cells before them, so neither a huge
    report nor a huge page meets in one task. The table blocks are written
    once, since rows and both count levels are derived from them.
    """
    celled = materialise(tables).withColumn("_pages", F.floor(F.col("page") / PAGES_PER_CELL)).withColumn(
        "_paras", F.floor(F.col("paragraph") / PARAGRAPHS_PER_CELL)
    )
    cell = ["filename", "_pages", "page", "_paras"]
    inside = Window.partitionBy(*cell).orderBy("paragraph")
    gap = F.col("paragraph") - F.lag("paragraph").over(inside)
    local = (
        celled.withColumn("_start", F.when(gap == 1, 0).otherwise(1))
        .withColumn("_seq", F.row_number().over(inside))
        .withColumn("_run", F.sum("_start").over(inside))
    )

    cells = local.groupBy(*cell).agg(
        F.min("paragraph").alias("_first"),
        F.max("paragraph").alias("_last"),
        F.count(F.lit(1)).alias("_n"),
        F.sum("_start").alias("_starts"),
    )
    group = Window.partitionBy("filename", "_pages").orderBy("page", "_paras")
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    same_page = F.lag("page").over(group) == F.col("page")
    touches = F.lag("_last").over(group) == F.col("_first") - 1
    cells = (
        cells.withColumn("_glued", F.when(same_page & touches, 1).otherwise(0))
        .withColumn("_starts", F.col("_starts") - F.col("_glued"))
        .withColumn("_n_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_s_before", F.coalesce(F.sum("_starts").over(before), F.lit(0)))
    )

    spans = cells.groupBy("filename", "_pages").agg(
        F.sum("_n").alias("_n"), F.sum("_starts").alias("_starts")
    )
    report = Window.partitionBy("filename")
    earlier = report.orderBy("_pages").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "filename",
        "_pages",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n_far"),
        F.coalesce(F.sum("_starts").over(earlier), F.lit(0)).alias("_s_far"),
        F.sum("_starts").over(report).alias("n_joined"),
    )
    shifts = shuffled_join(cells, spans, ["filename", "_pages"]).select(
        *cell,
        (F.col("_n_far") + F.col("_n_before")).alias("_n_shift"),
        (F.col("_s_far") + F.col("_s_before") - F.col("_glued")).alias("_s_shift"),
        "n_joined",
    )
    return (
        shuffled_join(local, shifts, cell)
        .withColumn("table_no", (F.col("_n_shift") + F.col("_seq")).cast("int"))
        .withColumn("joined_no", (F.col("_s_shift") + F.col("_run")).cast("int"))
        .withColumn("n_joined", F.col("n_joined").cast("int"))
        .drop("_pages", "_paras", "_start", "_seq", "_run", "_n_shift", "_s_shift")
    )


def find_tables(blocks: DataFrame) -> DataFrame:
    """Table blocks, numbered within each report."""
    tables = blocks.filter(is_table()).select("filename", "page", "paragraph", "text")
    return number_tables(tables).select(
        "filename", "table_no", "page", "paragraph", F.col("text").alias("raw_table_text")
    )


def stitch_tables(blocks: DataFrame) -> DataFrame:
    """Runs of adjacent table blocks as one table, placed at the first block.

    A white-space block inside a run keeps the run together but adds no text.
    """
    tables = blocks.filter(is_table()).select("filename", "page", "paragraph", "text")
    piece = F.struct("paragraph", "text", is_blank("text").alias("blank"))
    joined = (
        number_tables(tables)
        .groupBy("filename", "joined_no")
        .agg(
            F.min("page").alias("page"),
            F.min("paragraph").alias("paragraph"),
            F.sort_array(F.collect_list(piece)).alias("_pieces"),
        )
    )
    first = F.col("_pieces")[0]
    kept = F.filter(
        F.col("_pieces"), lambda p: (p["paragraph"] == first["paragraph"]) | ~p["blank"]
    )
    return joined.select(
        "filename",
        F.col("joined_no").alias("table_no"),
        "page",
        "paragraph",
        F.array_join(F.transform(kept, lambda p: p["text"]), "\n").alias("raw_table_text"),
    )


def table_summaries(blocks: DataFrame, keep_last_table: bool = False) -> DataFrame:
    """One replacement block ``<TABLE i CONTENTS(words) ENDTABLE>`` per stitched table.

    Each block is reduced to words before the shuffle. By default the last
    table of a report leaves nothing, as the established rule has it;
    ``keep_last_table=True`` keeps it.
    """
    tables = blocks.filter(is_table()).select(
        "filename", "page", "paragraph", F.array_join(word_entries(), " ").alias("words")
    )
    numbered = number_tables(tables)
    if not keep_last_table:
        numbered = numbered.filter(F.col("joined_no") < F.col("n_joined"))
    worded = F.when(F.col("words") != "", F.struct("paragraph", "words"))
    joined = numbered.groupBy("filename", "joined_no").agg(
        F.min("page").alias("page"),
        F.min("paragraph").alias("paragraph"),
        F.sort_array(F.collect_list(worded)).alias("_pieces"),
    )
    words = strip(F.array_join(F.transform("_pieces", lambda p: p["words"]), " "))
    text = F.concat(
        F.lit("<TABLE "), F.col("joined_no").cast("string"), F.lit(" CONTENTS("), words, F.lit(") ENDTABLE>")
    )
    return joined.select("filename", "page", "paragraph", text.alias("text"))


def substitute_tables(
    blocks: DataFrame, table_contents: bool = True, keep_last_table: bool = False, write_tables: bool = False
) -> DataFrame:
    """Blocks with every table replaced by its summary (or removed).

    ``write_tables`` stores the summaries (small next to the text) for plans
    that go through the result more than once.
    """
    plain = blocks.filter(~is_table()).select("filename", "page", "paragraph", "text")
    if not table_contents:
        return plain.filter(~F.startswith("text", F.lit("<TABLE")))
    summaries = table_summaries(blocks, keep_last_table)
    return plain.unionByName(materialise(summaries) if write_tables else summaries)


def drop_junk(blocks: DataFrame) -> DataFrame:
    """Without empty blocks and blocks that hold a junk marker."""
    clean = F.col("text") != ""
    for marker in JUNK_MARKERS:
        clean = clean & ~F.contains("text", F.lit(marker))
    return blocks.filter(clean)


def normalise(blocks: DataFrame) -> DataFrame:
    """White space and non-ASCII characters to single spaces."""
    return blocks.withColumn("text", squash("text"))


def clean_blocks(
    blocks: DataFrame, table_contents: bool = True, keep_last_table: bool = False, write_tables: bool = False
) -> DataFrame:
    """Full clean: tables, junk, normalisation; ``filename, page, paragraph, text``."""
    return (
        blocks.transform(substitute_tables, table_contents, keep_last_table, write_tables)
        .transform(drop_junk)
        .transform(normalise)
    )


def pages_after_cleaning(blocks: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Every page of the input with the number of blocks left, zero included."""
    pages = blocks.groupBy("filename", "page").agg(F.count(F.lit(1)).alias("n_before"))
    left = cleaned.groupBy("filename", "page").agg(F.count(F.lit(1)).alias("n_after"))
    return pages.join(left, ["filename", "page"], "left").withColumn(
        "n_after", F.coalesce("n_after", F.lit(0))
    )


def table_cells(tables: DataFrame) -> DataFrame:
    """Raw tables as cells: ``filename, table_no, row_no, col_no, header, value, is_ragged``.

    The entries before the first numeric one (counted among adjacent
    non-blank line ends) are headers, preceded by ``Index``; the rest fills
    rows from left to right. Tables without any such entry give no rows.
    """
    breaks = F.regexp_extract_all("raw_table_text", F.lit(f"({NOT_SPACE}\\n{NOT_SPACE})"), F.lit(1))
    sized = tables.withColumn("_breaks", breaks).filter(F.size("_breaks") > 0)
    numeric = F.array_position(F.transform("_breaks", lambda b: b.rlike(r"(?U)\n\d")), True)
    lines = F.split("raw_table_text", "\n")
    shaped = (
        sized.withColumn("_n", F.when(numeric > 0, numeric - 1).otherwise(F.size("_breaks") - 1).cast("int"))
        .withColumn("_lines", F.slice(lines, 1, F.size(lines) - 1))
        .withColumn("_width", F.col("_n") + 1)
    )
    cells = shaped.select(
        "filename",
        "table_no",
        "_n",
        "_width",
        "_lines",
        F.posexplode(F.slice("_lines", F.col("_n") + 1, F.greatest(F.size("_lines") - F.col("_n"), F.lit(0)))),
    )
    col_no = F.col("pos") % F.col("_width")
    return cells.select(
        "filename",
        "table_no",
        F.floor(F.col("pos") / F.col("_width")).cast("int").alias("row_no"),
        col_no.cast("int").alias("col_no"),
        F.when(col_no == 0, F.lit("Index")).otherwise(F.get("_lines", (col_no - 1).cast("int"))).alias("header"),
        F.col("col").alias("value"),
        ((F.size("_lines") - F.col("_n")) % F.col("_width") != 0).alias("is_ragged"),
    )
