"""Report files, blocks and metadata as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_SCHEMA = "filename STRING, page INT, paragraph INT, text STRING"
NAME_MARK = "_Annual_Report_"
REPORT_TYPE = "Annual Report"


def scan_reports(spark: SparkSession, directories: Sequence[str] | str) -> DataFrame:
    """Files ending in exactly ``.pdf`` in the directories themselves: ``path, modificationTime, length, content``."""
    directories = [directories] if isinstance(directories, str) else list(directories)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(directories)


def decode_reports(files: DataFrame, decoder: Callable[[bytes], list[list[str]]]) -> DataFrame:
    """Block table from report files, given a decoder from bytes to block texts per page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # One file at a time, so memory is bounded by a report and not by a batch.
            for path, content in zip(batch["path"], batch["content"]):
                rows = [
                    (path.split("/")[-1], page, paragraph, text)
                    for page, blocks in enumerate(decoder(bytes(content)), 1)
                    for paragraph, text in enumerate(blocks, 1)
                ]
                yield pd.DataFrame(rows, columns=["filename", "page", "paragraph", "text"])

    return files.select("path", "content").mapInPandas(run, BLOCK_SCHEMA)


def split_blocks(
    df: DataFrame, filename: Column, pieces: Column, blocks_per_page: int
) -> DataFrame:
    """Blocks from an array of texts per row, ``blocks_per_page`` to a page."""
    exploded = df.select(filename.alias("filename"), F.posexplode_outer(pieces).alias("pos", "text"))
    exploded = exploded.filter(F.col("pos").isNotNull())
    return exploded.select(
        "filename",
        (F.floor(F.col("pos") / blocks_per_page) + 1).cast("int").alias("page"),
        (F.col("pos") % blocks_per_page + 1).cast("int").alias("paragraph"),
        "text",
    )


def blocks_from_text(df: DataFrame, filename: Column, text: str = "text", blocks_per_page: int = 4) -> DataFrame:
    """Blocks are the lines of a text column."""
    return split_blocks(df, filename, F.split(text, "\n"), blocks_per_page)


def blocks_from_html(df: DataFrame, filename: Column, html: str = "html", blocks_per_page: int = 4) -> DataFrame:
    """Blocks are the texts between block-level tags of an HTML column; blank ones are left out."""
    body = F.col(html)
    for hidden in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->"):
        body = F.regexp_replace(body, hidden, "")
    body = F.regexp_replace(body, r"(?i)</?(p|div|li|ul|ol|h[1-6]|tr|td|th|table|title|head|body|nav|br|footer|header|section|article)\b[^>]*>", "\u0001")
    body = F.regexp_replace(body, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    pieces = F.filter(F.split(body, "\u0001"), lambda t: t.rlike(r"[^ \n\r\t]"))
    return split_blocks(df, filename, pieces, blocks_per_page)


def blocks_from_turns(df: DataFrame, filename: Column, page: Column, text: str = "text") -> DataFrame:
    """One row per (report, page) with lines as blocks, e.g. conversation turns as pages."""
    return df.select(
        filename.alias("filename"),
        page.cast("int").alias("page"),
        F.posexplode(F.split(text, "\n")).alias("pos", "text"),
    ).select("filename", "page", (F.col("pos") + 1).cast("int").alias("paragraph"), "text")


def report_name(filename: Column) -> Column:
    """Company name: the part before the mark, underscores as spaces; null without the mark."""
    parts = F.split(filename, NAME_MARK)
    return F.when(F.size(parts) > 1, F.replace(parts[0], F.lit("_"), F.lit(" ")))


def report_year(filename: Column) -> Column:
    """Year, as text: the part after the mark up to a dot; null without the mark."""
    return F.split(F.get(F.split(filename, NAME_MARK), 1), r"\.")[0]


def report_metadata(files: DataFrame, path: str = "path") -> DataFrame:
    """``filename, name, type, year`` from file names; files without the mark have null name and year."""
    filename = F.element_at(F.split(path, "/"), -1)
    names = files.select(filename.alias("filename")).distinct()
    return names.select(
        "filename",
        report_name(F.col("filename")).alias("name"),
        F.lit(REPORT_TYPE).alias("type"),
        report_year(F.col("filename")).alias("year"),
    )


def parsed_reports(metadata: DataFrame) -> DataFrame:
    """Reports whose file name could be read."""
    return metadata.filter(F.col("year").isNotNull())


def quarantined_reports(metadata: DataFrame) -> DataFrame:
    """Reports whose file name holds no company and year; kept aside, never lost silently."""
    return metadata.filter(F.col("year").isNull()).select("filename", "type")


def first_reports(blocks: DataFrame, n: int) -> DataFrame:
    """All blocks of the first ``n`` reports by file name."""
    chosen = blocks.select("filename").distinct().orderBy("filename").limit(n)
    # ``n`` rows at most, but ``n`` is the caller's: leave the join choice to Spark.
    return blocks.join(chosen, "filename", "left_semi")
