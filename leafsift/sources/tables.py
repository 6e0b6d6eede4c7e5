"""Labelled passages and match tables in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LABELLED_SCHEMA = "text STRING, class INT"
MATCH_SCHEMA = ("filename STRING, name STRING, year STRING, metric STRING, page INT, paragraph INT, text STRING, match_string STRING, "
                "start INT, end INT")


def read_labelled(spark: SparkSession, path: str, schema: str = LABELLED_SCHEMA, multi_line: bool = True) -> DataFrame:
    """Labelled passages from CSV with a header; texts may span lines.

    Where none does, ``multi_line=False`` lets Spark split large files.
    """
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", multi_line)
        .option("quote", '"').option("escape", '"').csv(path)
    )


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """A match table that was written as CSV."""
    return spark.read.schema(MATCH_SCHEMA).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def write_matches(matches: DataFrame, path: str, fmt: str = "csv") -> None:
    """Match table as CSV with a header, or as parquet."""
    writer = matches.write.mode("overwrite")
    if fmt == "csv":
        # Blanks at the ends are part of a text.
        writer.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False).csv(path)
    else:
        writer.format(fmt).save(path)
