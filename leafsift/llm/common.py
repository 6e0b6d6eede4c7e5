"""Small helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsift.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"


def staged(df: DataFrame, what: str, *partitions: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several later steps need the same rows, so that neither the
    steps nor the loss of an executor compute them again. ``clean_up`` of the
    session module removes the folder of a run.
    """
    folder = shared_dir(df.sparkSession)
    if folder is None:
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    path = f"{folder}/llm-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(partitions) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the fast way."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever else (and in whatever order) the table holds."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*names)
