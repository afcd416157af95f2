"""Quality report: what there is to know about the raw tables, by part."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza import functions as fn
from cadenza.functions.calendar import DEFAULT_ANCHOR
from cadenza.operators import profile
from cadenza.operators.panel import with_week
from cadenza.session import materialized


def quality_report(
    sessions: DataFrame,
    tracks: DataFrame,
    artists: DataFrame | None = None,
    users: DataFrame | None = None,
    anchor: date = DEFAULT_ANCHOR,
    bins: int = 50,
) -> dict[str, DataFrame]:
    """Named parts of the report, each a DataFrame of its own.

    `sessions` is the raw log, `tracks` is keyed by track_id, `artists` by id; `users` has the list column
    favourite_genres.  The log is read three times: for its totals by event type and week, which are
    written and serve all parts on them, for its tracks with their counts, likewise, and for its users.
    """
    cells = materialized(
        with_week(sessions, anchor).groupBy("event_type", "week").agg(
            F.count(F.lit(1)).alias("_n"), F.count_if(F.col("track_id").isNull()).alias("_missing"),
            F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"),
            *[F.count(F.col(c)).alias(f"_of_{c}") for c in sessions.columns]),
        "log-cells")
    heard = materialized(
        sessions.filter(F.col("track_id").isNotNull()).groupBy("track_id").agg(F.count(F.lit(1)).alias("n")), "log-tracks")
    types = cells.filter(F.col("event_type").isNotNull()).groupBy("event_type")
    span = cells.agg(F.min("_first").alias("first"), F.max("_last").alias("last"))
    weeks = fn.week_since_anchor("last", anchor) - fn.week_since_anchor("first", anchor) + 1
    n = F.coalesce(F.sum("_n"), F.lit(0))
    info = cells.agg(n.alias("_total"), *[F.coalesce(F.sum(f"_of_{c}"), F.lit(0)).alias(c) for c in sessions.columns])
    parts = {
        "sessions_info": info.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col("_total").alias("n_rows"),
                     F.col(f"`{c}`").alias("n_non_null"), (F.col("_total") - F.col(f"`{c}`")).alias("n_null"))
            for c, t in sessions.dtypes]))),
        "sessions_missing_track": types.agg(F.sum("_missing").alias("n_missing")),
        "sessions_event_types": types.agg(F.sum("_n").alias("n")).orderBy(F.desc("n"), "event_type"),
        "sessions_time_span": span.withColumn("n_weeks", weeks),
        "sessions_per_week": cells.groupBy("week").agg(F.sum("_n").alias("n")),
        "sessions_distinct": profile.count_distinct(sessions, ["user_id"]).withColumn(
            "track_id", heard.agg(F.count(F.lit(1))).scalar()).select("track_id", "user_id"),
        "sessions_unknown_tracks": heard.join(tracks.select("track_id"), "track_id", "left_anti"),
        "tracks_info": profile.table_info(tracks),
        "tracks_histogram": profile.histogram(
            tracks, [c for c in profile.numeric_columns(tracks) if c != "track_id"], bins
        ),
        "tracks_duplicate_ids": profile.duplicate_ids(tracks, "track_id"),
        "tracks_silent": tracks.join(heard, "track_id", "left_anti").agg(F.count(F.lit(1)).alias("n")),
    }
    if artists is not None:
        parts["artists_info"] = profile.table_info(artists)
        parts["artists_duplicate_ids"] = profile.duplicate_ids(artists, "id")
        parts["artists_distinct"] = profile.count_distinct(tracks, ["id_artist"])
        parts["artists_without_tracks"] = artists.select("id").join(
            tracks.select(F.col("id_artist").alias("id")), "id", "left_anti"
        )
    if users is not None:
        parts["users_info"] = profile.table_info(users)
        parts["users_genres"] = profile.explode_value_counts(users, "favourite_genres")
    return parts
