"""Profiling: counts, nulls, duplicates, distributions."""

from __future__ import annotations

from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza import functions as fn
from cadenza.functions.calendar import DEFAULT_ANCHOR


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each non-null value, most frequent first."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), column)


def duplicate_ids(df: DataFrame, column: str = "id") -> DataFrame:
    """Values that occur more than once, with their count."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter("n > 1")


def count_distinct(df: DataFrame, columns: list[str], relative_error: float | None = None) -> DataFrame:
    """Distinct non-null values of each column, exact or by sketch; one row."""
    if relative_error is None:
        return df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    return df.agg(*[F.approx_count_distinct(c, relative_error).alias(c) for c in columns])


def table_info(df: DataFrame) -> DataFrame:
    """Per column: type, rows, non-null and null values; one pass over the table."""
    names = df.columns
    totals = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(names)])
    lines = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            F.lit(dtype).alias("dtype"),
            F.col("_rows").alias("n_rows"),
            F.col(f"_{i}").alias("n_non_null"),
            (F.col("_rows") - F.col(f"_{i}")).alias("n_null"),
        )
        for i, (c, dtype) in enumerate(df.dtypes)
    ])
    return totals.select(F.inline(lines))


def null_counts(df: DataFrame) -> DataFrame:
    return table_info(df).select("column", "n_null")


def missing_by_event_type(sessions: DataFrame) -> DataFrame:
    """Events without a track, per event type."""
    return (
        sessions.filter(F.col("event_type").isNotNull())
        .groupBy("event_type")
        .agg(F.count_if(F.col("track_id").isNull()).alias("n_missing"))
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = 50) -> DataFrame:
    """Equal-width bin counts per numeric column; the last bin includes the maximum.

    Only non-empty bins are returned.  A constant column has one bin, 0.  The ranges come from one row
    of aggregates; the second pass counts all columns' bins of a task in one array, so neither
    multiplies the rows by the columns.
    """
    columns = columns or numeric_columns(df)
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    finite = [F.when(~F.isnan(c), F.col(c)) for c in values.columns]
    ranges = values.agg(*[F.min(c) for c in finite], *[F.max(c) for c in finite]).first()
    low, high = (np.array([np.nan if x is None else x for x in part], dtype=float) for part in (ranges[:len(columns)], ranges[len(columns):]))
    width = (high - low) / bins

    def count(batches):
        counts = np.zeros((len(columns), bins), dtype=np.int64)
        for batch in batches:
            for i in range(len(columns)):
                value = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                value = value[~np.isnan(value)]
                place = np.minimum(np.floor((value - low[i]) / width[i]), bins - 1).astype(np.int64) if width[i] > 0 else np.zeros(len(value), np.int64)
                counts[i] += np.bincount(place, minlength=bins)
        column, place = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([columns[i] for i in column], pa.string()), pa.array(place, pa.int32()), pa.array(low[column] + place * width[column], pa.float64()),
             pa.array(counts[column, place], pa.int64())], ["attr", "bin", "bin_start", "n"])

    partial = values.mapInArrow(count, "attr string, bin int, bin_start double, n long")
    return partial.groupBy("attr", "bin", "bin_start").agg(F.sum("n").alias("n"))


def weekly_event_histogram(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("week").agg(F.count(F.lit(1)).alias("n"))


def time_span(sessions: DataFrame, anchor: date = DEFAULT_ANCHOR) -> DataFrame:
    """First and last timestamp and the number of weeks they span, both included."""
    span = sessions.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    weeks = fn.week_since_anchor("last", anchor) - fn.week_since_anchor("first", anchor) + 1
    return span.withColumn("n_weeks", weeks)


def explode_value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of list elements, most frequent first."""
    return value_counts(df.select(F.explode(column).alias(column)), column)


def counts_to_map(counts: DataFrame, key: str, value: str = "n", limit: int = 100_000) -> DataFrame:
    """Value counts as one map, which one task has to hold: more than `limit` values are refused with an error."""
    few = counts.limit(limit + 1).agg(F.collect_list(F.struct(key, value)).alias("entries"))
    refused = F.raise_error(F.lit(f"more than {limit} distinct values of {key} do not go into a map"))
    return few.select(F.map_from_entries(
        F.when(F.size("entries") > limit, refused).otherwise(F.sort_array("entries"))).alias("counts"))


def semi_join_active(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of tracks that occur in the log."""
    active = sessions.select("track_id").filter(F.col("track_id").isNotNull()).distinct()
    return rows.join(active, "track_id", "left_semi")


def silent_tracks(tracks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Tracks that never occur in the log."""
    active = sessions.select("track_id").filter(F.col("track_id").isNotNull()).distinct()
    return tracks.join(active, "track_id", "left_anti")


def unknown_tracks(sessions: DataFrame, tracks: DataFrame) -> DataFrame:
    """Events per track id that the catalogue does not have; they reach no feature."""
    played = sessions.filter(F.col("track_id").isNotNull()).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    return played.join(tracks.select("track_id"), "track_id", "left_anti")
