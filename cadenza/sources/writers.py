"""Sinks.  All writing is done by the executors."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.plans.features import rows_by_week
from cadenza.sources.readers import CSV_TEXT, track_bucket

# Text formats would otherwise cut timestamps to milliseconds.
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_csv(df: DataFrame, path: str) -> None:
    """Headed CSV with doubled quotes; null is an empty cell, the empty string an empty cell in quotes."""
    options = {**CSV_TEXT, "nullValue": "", "emptyValue": '""', "timestampNTZFormat": TIMESTAMP_FORMAT}
    df.write.mode("overwrite").options(**options).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("timestampNTZFormat", TIMESTAMP_FORMAT).json(path)


def write_features(features: DataFrame, path: str, format: str = "parquet") -> None:
    """Write the feature table; Parquet is laid out by week.

    Training and top lists read whole weeks, so they open only those folders.  The rebalancing lets Spark
    split a large week among several writers and merge small ones by measured size; inside a
    file tracks are in order, so a reader of one track skips row groups.

    A table of `feature_tracks` is laid out by week as well, but shuffled with many weeks in a row and expanded after that.

    Format "tracks" takes a table of `feature_tracks` and stores it as it is, one row per track: no row of the
    dense grid is shuffled or written, `read_features` expands it.
    """
    if format == "csv":
        write_csv(features, path)
        return
    if format == "tracks":
        features.write.mode("overwrite").parquet(path)
        return
    if "_cells" in features.columns:
        laid_out = rows_by_week(features)
    else:
        laid_out = features.hint("rebalance", "week").sortWithinPartitions("week", "track_id")
    laid_out.write.mode("overwrite").partitionBy("week").parquet(path)


def write_histories(features: DataFrame, path: str, buckets: int = 256) -> None:
    """A copy of the feature table for reading single tracks: laid out by a hash of the track, not by week.

    The folders are named after the number of buckets, which a reader needs; inside a file tracks are in order.
    A table of `feature_tracks` is stored with its one row per track, which `read_history` expands.
    """
    column = f"bucket_of_{buckets}"
    placed = features.withColumn(column, track_bucket(F.col("track_id"), buckets))
    order = [c for c in (column, "track_id", "week") if c in placed.columns]
    laid_out = placed.hint("rebalance", column).sortWithinPartitions(*order)
    laid_out.write.mode("overwrite").partitionBy(column).parquet(path)


def json_keys(spark: SparkSession, path: str) -> list[str]:
    """All keys of the records, in the order they first come.  As many as the table has columns."""
    records = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("record"), F.posexplode(F.json_object_keys("value")).alias("at", "key"))
    first = records.groupBy("key").agg(F.min(F.struct("record", "at")).alias("first"))
    return [r["key"] for r in first.orderBy("first", "key").collect()]


def jsonl_to_csv(spark: SparkSession, jsonl_path: str, csv_path: str, schema: T.StructType | None = None) -> list[str]:
    """Convert JSON lines to headed CSV and return the header.

    Every record is kept and values are placed by name.  Without a schema the header is the union of all
    records' keys, in the order they first come, read as text.
    """
    if schema is None:
        schema = T.StructType([T.StructField(k, T.StringType()) for k in json_keys(spark, jsonl_path)])
    write_csv(spark.read.schema(schema).option("mode", "FAILFAST").json(jsonl_path), csv_path)
    return schema.fieldNames()


def without_vectors(df: DataFrame) -> DataFrame:
    """Vector columns as plain arrays, which every format can hold."""
    def plain(field) -> Column:
        c = F.col(field.name)
        return vector_to_array(c).alias(field.name) if isinstance(field.dataType, VectorUDT) else c

    return df.select(*[plain(f) for f in df.schema.fields])


def write_predictions_json(scored: DataFrame, path: str) -> None:
    """All columns, as gzipped JSON lines: a row holds its inputs twice, with their names, mostly zeros."""
    without_vectors(scored).write.mode("overwrite").options(timestampNTZFormat=TIMESTAMP_FORMAT, compression="gzip").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric name and value, one JSON object per line."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def rows_as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON object in column `value`."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
