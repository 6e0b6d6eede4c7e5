"""A corpus through five operators: from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsift.llm.common import staged, table
from leafsift.llm.decontamination import without_benchmark
from leafsift.llm.language_id import in_known_languages
from leafsift.llm.line_dedup import without_common_lines
from leafsift.llm.packing import pack_documents
from leafsift.llm.simhash import one_of_each_group


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language stays undecided, or that have no letters, go."""
    return in_known_languages(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go; ``n_chars`` follows the text."""
    kept = without_common_lines(docs, min_docs=10, min_chars=1)
    return kept.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints linked at 2 bits or fewer stays."""
    return one_of_each_group(docs, words=3, bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or a whole shorter item) go."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"), window=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in as few sequences as best-fit decreasing needs."""
    return pack_documents(docs, capacity=1024)


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("near dedup", near_dedup),
          ("decontamination", decontamination), ("packing", packing)]

#: Language decisions are sums of floating-point evidence, fingerprints and packing are sequential algorithms: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
