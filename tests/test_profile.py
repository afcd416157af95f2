import pytest
from datetime import date, datetime

import numpy as np
from conftest import rows

from cadenza.operators import profile
from cadenza.plans.quality import quality_report


def test_histogram_matches_numpy_and_keeps_the_maximum(spark):
    values = [0.0, 0.5, 1.0, 1.0, 2.5, 9.99, 10.0, None]
    df = spark.createDataFrame([(v, 7) for v in values], "x double, same long")
    got = rows(profile.histogram(df, bins=10), "attr", "bin")
    counts, edges = np.histogram([v for v in values if v is not None], bins=10)
    wanted = [("same", 0, 7.0, 8)] + [("x", i, edges[i], n) for i, n in enumerate(counts) if n]
    assert got == wanted


def test_counts_duplicates_nulls(spark):
    df = spark.createDataFrame([("-1", None), ("-1", ["pop"]), ("b", []), (None, None), (None, None)], "id string, genres array<string>")
    assert rows(profile.duplicate_ids(df)) == [("-1", 2)]
    assert rows(profile.value_counts(df, "id")) == [("-1", 2), ("b", 1)]
    assert rows(profile.null_counts(df)) == [("id", 2), ("genres", 3)]
    assert rows(profile.table_info(df)) == [("id", "string", 5, 3, 2), ("genres", "array<string>", 5, 2, 3)]
    assert rows(profile.count_distinct(df, ["id"])) == [(2,)]
    assert rows(profile.count_distinct(df, ["id"], 0.05)) == [(2,)]
    assert rows(profile.explode_value_counts(df, "genres")) == [("pop", 1)]
    assert profile.counts_to_map(profile.value_counts(df, "id"), "id").first()[0] == {"-1": 2, "b": 1}


def test_time_span_across_years(spark):
    df = spark.createDataFrame([(datetime(2020, 12, 28),), (datetime(2022, 1, 3),)], "timestamp timestamp_ntz")
    assert profile.time_span(df, date(2020, 12, 28)).first()["n_weeks"] == 54


def test_quality_report_parts(spark, make_log):
    log = make_log([
        ("2021-01-05T10:00:00", 1, "a", "play"), ("2021-01-12T10:00:00", 2, None, "advertisement"),
        ("2021-01-12T11:00:00", 2, "gone", "skip"), ("2021-01-12T12:00:00", 2, "a", None),
    ])
    tracks = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), (None, None, 3)], "track_id string, id_artist string, key int")
    artists = spark.createDataFrame([("x",), ("-1",), ("-1",)], "id string")
    users = spark.createDataFrame([(1, ["pop", "rock"]), (2, ["pop"])], "id long, favourite_genres array<string>")
    parts = quality_report(log, tracks, artists, users, date(2021, 1, 4))
    assert rows(parts["sessions_missing_track"], "event_type") == [("advertisement", 1), ("play", 0), ("skip", 0)]
    assert rows(parts["sessions_per_week"], "week") == [(1, 1), (2, 3)]
    assert rows(parts["sessions_unknown_tracks"]) == [("gone", 1)]
    assert rows(parts["sessions_distinct"]) == [(2, 2)]
    assert rows(parts["artists_duplicate_ids"]) == [("-1", 2)]
    assert rows(parts["artists_without_tracks"]) == [("-1",), ("-1",)]
    assert rows(parts["users_genres"]) == [("pop", 2), ("rock", 1)]
    # A track without an id matches no event and is silent.
    assert rows(parts["tracks_silent"]) == [(2,)]
    for part in parts.values():
        part.collect()


def test_a_map_of_too_many_values_is_refused(spark):
    counts = profile.value_counts(spark.range(20).selectExpr("id % 6 AS id"), "id")
    assert len(profile.counts_to_map(counts, "id", limit=6).first()[0]) == 6
    with pytest.raises(Exception, match="more than 5 distinct values"):
        profile.counts_to_map(counts, "id", limit=5).collect()
