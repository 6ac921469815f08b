"""The Spark session of the engine: UTC, ANSI, adaptive execution; checkpoints that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not folder and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="tidemark-checkpoints-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, for loops: a checkpoint keeps the constraints of what it was made from, which
    grow from round to round, and computes its rows twice."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame, most: int) -> int:
    """As many tasks as it takes for about `most` rows of df in each, at least one for each core. The rows are counted."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // most))


def dealt(df: DataFrame, most: int, *by: str) -> DataFrame:
    """df dealt out by columns over as many tasks as it takes for about `most` rows in each, so a task's memory doesn't grow
    with the input; at least one for each core. The rows are counted first."""
    return df.repartition(tasks(df, most), *by)


def session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
