"""Spark session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def build_session(app_name: str = "cadenza", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is written for.

    UTC keeps week borders independent of the machine; AQE sizes partitions,
    splits skewed joins and turns a join into a broadcast only when the
    measured size of a side allows it.  The number of shuffle partitions is
    left to the caller or the cluster defaults.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or else one below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


_materialized: list[tuple[str, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/cadenza/{name}-{uuid.uuid4().hex}"


def release_scratch(spark: SparkSession) -> int:
    """Empty the tables that `materialized` wrote in this application; how many they were.

    For the caller, once it has taken what it wants from the DataFrames that read them: a
    lazy result cannot know when it was last used.
    """
    mine = [x for x in _materialized if x[0] == spark.sparkContext.applicationId]
    for entry in mine:
        spark.range(0).write.mode("overwrite").parquet(entry[1])
        _materialized.remove(entry)
    return len(mine)


def materialized(df, name: str):
    """Write a table that several passes read, and read it back by column."""
    path = scratch_path(df.sparkSession, name)
    _materialized.append((df.sparkSession.sparkContext.applicationId, path))
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
