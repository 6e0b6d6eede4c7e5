"""Session helpers for tests and the benchmark; on a cluster pass your own session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "leafsift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (AQE, UTC, ANSI as is)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str | None:
    """This run's folder for intermediate tables, shared by driver and executors; None if the session names none.

    It lies in ``spark.checkpoint.dir`` (the setting or the context's folder).
    On a local master the warehouse folder serves as well; a cluster session
    never falls back to a folder of one machine.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path is None and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        path = spark.conf.get("spark.sql.warehouse.dir")
    return path and f"{path}/leafsift-{context.applicationId}"


def materialise(df: DataFrame, needed: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For an intermediate result that several branches of a plan need: it is
    computed once, and the loss of an executor does not lose it. Without a
    shared folder the plan stays as it is and is computed again where needed;
    with ``needed``, as in loops whose plans would grow from round to round,
    that is an error.
    """
    folder = shared_dir(df.sparkSession)
    if folder is None:
        if needed:
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        return df
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Delete this run's folder; results that still read from it must be written before."""
    folder = shared_dir(spark)
    if folder is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
