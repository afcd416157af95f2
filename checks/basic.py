"""Sources, projections, filters, sorts."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza import functions as fn
from cadenza import sources
from cadenza.operators import panel as p
from cadenza.operators import profile
from cadenza.operators.ranking import label_encode
from cadenza.operators.sequence import without_likes
from cadenza.plans.toplist import top_n
from cadenza.session import scratch_path
from checks import feature_views as fv
from checks import views as v
from checks.registry import check, q6, r6

E = v.with_views("sessions_e")
T_ = v.with_views("tracks")

LOG_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("track_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
])
RAW_LOG = 'SELECT event_id, "timestamp", user_id, track_id, event_type FROM sessions_e'
CATALOGUE_SCHEMA = T.StructType([
    T.StructField("track_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("danceability", T.DoubleType()),
    T.StructField("release_date", T.StringType()),
])
CATALOGUE = CATALOGUE_SCHEMA.fieldNames()


# Sources and sinks

@check("scan_jsonl", f"{E} {RAW_LOG}")
def scan_jsonl(spark, d):
    path = scratch_path(spark, "jsonl")
    sources.write_jsonl(v.sessions_e(spark, d), path)
    return sources.read_jsonl(spark, path, LOG_SCHEMA)


@check("scan_csv", f"{T_} SELECT {', '.join(CATALOGUE)} FROM tracks")
def scan_csv(spark, d):
    path = scratch_path(spark, "csv")
    sources.write_csv(v.tracks(spark, d).select(*CATALOGUE), path)
    return sources.read_csv(spark, path, CATALOGUE_SCHEMA)


@check("jsonl_to_csv", f"{E} {RAW_LOG}")
def jsonl_to_csv(spark, d):
    source, target = scratch_path(spark, "jsonl"), scratch_path(spark, "csv")
    sources.write_jsonl(v.sessions_e(spark, d), source)
    sources.jsonl_to_csv(spark, source, target, LOG_SCHEMA)
    return sources.read_csv(spark, target, LOG_SCHEMA)


@check("jsonl_to_csv_keys", f"""{E} SELECT event_type, CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id,
    CAST(track_id AS VARCHAR) AS track_id FROM sessions_e""")
def jsonl_to_csv_keys(spark, d):
    """Without a schema: the header is made of the records' keys, of which many lack track_id."""
    source, target = scratch_path(spark, "jsonl"), scratch_path(spark, "csv")
    sources.write_jsonl(v.sessions_e(spark, d).drop("timestamp"), source)
    header = sources.jsonl_to_csv(spark, source, target)
    return sources.read_csv(spark, target, T.StructType([T.StructField(c, T.StringType()) for c in header]))


@check("cached_dimension", f"{T_} SELECT track_id, name, id_artist, popularity FROM tracks")
def cached_dimension(spark, d):
    def read(session, path):
        return v.tracks(session, os.path.dirname(path)).select("track_id", "name", "id_artist", "popularity")

    return sources.cached_dimension(spark, f"{d}/part.parquet", read, "tracks")


@check("sink_csv", f"{fv.FEATURES_E} SELECT * REPLACE ({q6('lag_playtime_ratio')} AS lag_playtime_ratio) FROM features")
def sink_csv(spark, d):
    path = scratch_path(spark, "features")
    features = fv.features_e(spark, d)
    sources.write_features(features, path, format="csv")
    back = sources.read_csv(spark, path, features.schema)
    return back.withColumn("lag_playtime_ratio", r6("lag_playtime_ratio"))


@check("rows_as_json", f"""{T_} SELECT CAST(to_json({{'track_id': track_id, 'name': name, 'popularity': popularity}}) AS VARCHAR) AS value FROM tracks""")
def rows_as_json(spark, d):
    return sources.rows_as_json(v.tracks(spark, d).select("track_id", "name", "popularity"))


# Projections and expressions

@check("project_columns", f"{fv.FEATURES_E} SELECT track_id, week, play_count FROM features")
def project_columns(spark, d):
    return fv.features_e(spark, d).select("track_id", "week", "play_count")


@check("rename_columns", f"{T_} SELECT track_id AS id, name AS title, id_artist AS artist FROM tracks")
def rename_columns(spark, d):
    tracks = v.tracks(spark, d).select("track_id", "name", "id_artist")
    return tracks.withColumnsRenamed({"track_id": "id", "name": "title", "id_artist": "artist"})


@check("drop_columns", f"{T_} SELECT * EXCLUDE (name, id_artist, release_date) FROM tracks")
def drop_columns(spark, d):
    return v.tracks(spark, d).drop("name", "id_artist", "release_date")


@check("with_constant", f"{E} SELECT event_id, CAST(1 AS DOUBLE) AS playtime_ratio FROM sessions_e")
def with_constant(spark, d):
    return v.sessions_e(spark, d).select("event_id").withColumn("playtime_ratio", F.lit(1.0))


@check("conditional_assign", f"""{E} SELECT event_id, CASE WHEN event_type = 'skip' THEN user_id * 2 ELSE user_id END AS user_id
    FROM sessions_e""")
def conditional_assign(spark, d):
    mask = F.col("event_type") == "skip"
    value = F.when(mask, F.col("user_id") * 2).otherwise(F.col("user_id"))
    return v.sessions_e(spark, d).select("event_id", value.alias("user_id"))


@check("parse_timestamp", f"""{E} SELECT event_id, CAST(CAST("timestamp" AS VARCHAR) AS TIMESTAMP) AS parsed FROM sessions_e""")
def parse_timestamp(spark, d):
    text = v.sessions_e(spark, d).select("event_id", F.col("timestamp").cast("string").alias("text"))
    return text.select("event_id", fn.parse_timestamp("text").alias("parsed"))


@check("release_year", f"{T_} SELECT track_id, coalesce({v.YEAR}, 0) AS release_year FROM tracks")
def release_year(spark, d):
    year = v.tracks(spark, d).select("track_id", fn.release_year("release_date").alias("release_year"))
    return p.fill_zero(year)


@check("week_since_anchor", f"{E} SELECT event_id, week FROM sessions_e")
def week_since_anchor(spark, d):
    return v.sessions_e(spark, d).select("event_id", fn.week_since_anchor("timestamp", v.ANCHOR_E).alias("week"))


@check("iso_week", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(extract(week FROM l_shipdate) AS INT) AS iso_week FROM lineitem""")
def iso_week(spark, d):
    return v.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", fn.iso_week("l_shipdate").alias("iso_week")
    )


@check("sunday_week", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(strftime(l_shipdate, '%U') AS INT) AS sunday_week FROM lineitem""")
def sunday_week(spark, d):
    return v.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", fn.sunday_week("l_shipdate").alias("sunday_week")
    )


@check("elapsed_ms", f"""{E} SELECT event_id, {q6('''CAST(epoch_us("timestamp") - epoch_us(TIMESTAMP '2024-01-01') AS DOUBLE) / 1000''')} AS elapsed_ms FROM sessions_e""")
def elapsed_ms(spark, d):
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return v.sessions_e(spark, d).select("event_id", r6(fn.elapsed_ms(start, "timestamp")).alias("elapsed_ms"))


@check("listenability", f"{fv.LISTEN_L} SELECT track_id, week, {q6('listenability')} AS listenability FROM listen")
def listenability(spark, d):
    return fv.panel_l(spark, d).select("track_id", "week", r6("listenability").alias("listenability"))


@check("fill_zero", f"""{fv.PANEL_E} SELECT track_id, week,
    coalesce(lag(play_count) OVER (PARTITION BY track_id ORDER BY week), 0) AS lag_1 FROM panel""")
def fill_zero(spark, d):
    log, tracks = fv.log_e(spark, d), v.tracks(spark, d)
    panel = p.left_join_measures(p.track_week_grid(tracks, log), p.weekly_event_counts(log))
    return p.fill_zero(p.lagged(panel, {"lag_1": ("play_count", 1)}).select("track_id", "week", "lag_1"))


@check("label_encode", f"""{T_} SELECT track_id, id_artist, CAST(dense_rank() OVER (ORDER BY id_artist) - 1 AS BIGINT) AS artist_code FROM tracks""")
def label_encode_(spark, d):
    return label_encode(v.tracks(spark, d).select("track_id", "id_artist"), "id_artist", "artist_code")


@check("explode_array", f"""{v.with_views('users')} SELECT user_id, unnest(CASE WHEN len(favourite_genres) = 0 THEN [NULL] ELSE favourite_genres END) AS genre FROM users""")
def explode_array(spark, d):
    return v.users(spark, d).select("user_id", F.explode_outer("favourite_genres").alias("genre"))


@check("counts_to_map", v.with_views("users") + """
    SELECT genre, count(*) AS n FROM (SELECT unnest(favourite_genres) AS genre FROM users) GROUP BY genre""")
def counts_to_map(spark, d):
    counts = profile.explode_value_counts(v.users(spark, d), "favourite_genres")
    return profile.counts_to_map(counts, "favourite_genres").select(F.explode("counts").alias("genre", "n"))


# Filters

@check("filter_event_type", f"{E} SELECT event_id, event_type FROM sessions_e WHERE event_type IS DISTINCT FROM 'like'")
def filter_event_type(spark, d):
    return without_likes(v.sessions_e(spark, d)).select("event_id", "event_type")


@check("drop_partial_weeks", f"{E} SELECT event_id, week FROM sessions_e WHERE week NOT IN (1, 5)")
def drop_partial_weeks(spark, d):
    return fv.log_e(spark, d).select("event_id", "week")


@check("week_range_filter", f"{fv.FEATURES_L} SELECT track_id, week, play_count FROM features WHERE week > 4 AND week <= 42")
def week_range_filter(spark, d):
    rows = fv.feature_table(spark, d).filter((F.col("week") > 4) & (F.col("week") <= 42))
    return rows.select("track_id", "week", "play_count")


@check("week_set_filter", f"{fv.FEATURES_L} SELECT track_id, week, play_count FROM features WHERE week IN (126, 157)")
def week_set_filter(spark, d):
    rows = fv.feature_table(spark, d).filter(F.col("week").isin(126, 157))
    return rows.select("track_id", "week", "play_count")


@check("single_week", f"{fv.FEATURES_L} SELECT track_id, week, lag_1 FROM features WHERE week = 126")
def single_week(spark, d):
    return fv.feature_table(spark, d).filter("week = 126").select("track_id", "week", "lag_1")


@check("filter_null_key", f"{E} SELECT event_id, event_type FROM sessions_e WHERE event_type = 'advertisement' AND track_id IS NULL")
def filter_null_key(spark, d):
    rows = v.sessions_e(spark, d).filter((F.col("event_type") == "advertisement") & F.col("track_id").isNull())
    return rows.select("event_id", "event_type")


@check("non_null_values", f"{E} SELECT DISTINCT track_id FROM sessions_e WHERE track_id IS NOT NULL")
def non_null_values(spark, d):
    return v.sessions_e(spark, d).select("track_id").dropna().distinct()


@check("having_count", f"{E} SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM sessions_e GROUP BY user_id HAVING count(*) > 1")
def having_count(spark, d):
    return profile.duplicate_ids(v.sessions_e(spark, d), "user_id")


@check("track_history", f"{fv.FEATURES_L} SELECT track_id, week, play_count FROM features WHERE track_id = 27 ORDER BY week")
def track_history(spark, d):
    rows = sources.read_history(spark, fv.history_table(spark, d), 27).select("track_id", "week", "play_count")
    return rows.orderBy("week")


@check("track_history_by_week", f"{fv.FEATURES_L} SELECT track_id, week, play_count FROM features WHERE track_id = 27 ORDER BY week")
def track_history_by_week(spark, d):
    """The same from the table laid out by week, of which every folder is opened."""
    rows = fv.weekly_table(spark, d).filter("track_id = 27").select("track_id", "week", "play_count")
    return rows.orderBy("week")


# Sorts and limits

@check("sort_rows", f"{E} SELECT event_id, user_id FROM sessions_e ORDER BY user_id DESC, event_id")
def sort_rows(spark, d):
    return v.sessions_e(spark, d).select("event_id", "user_id").orderBy(F.col("user_id").desc(), "event_id")


@check("top_n", f"""{fv.FEATURES_L} SELECT track_id, play_count, CAST(row_number() OVER (ORDER BY play_count DESC, track_id) AS BIGINT) AS rank
    FROM features WHERE week = 126 ORDER BY play_count DESC, track_id LIMIT 20""")
def top_n_(spark, d):
    week = fv.feature_table(spark, d).filter("week = 126").select("track_id", "play_count")
    return top_n(week, "play_count", 20)


@check("head_rows", f"{T_} SELECT track_id, name FROM tracks ORDER BY track_id LIMIT 5")
def head_rows(spark, d):
    return v.tracks(spark, d).select("track_id", "name").orderBy("track_id").limit(5)
