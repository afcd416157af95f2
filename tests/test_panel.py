from datetime import date

from conftest import rows
from pyspark.sql import functions as F

from cadenza.operators import panel as p
from cadenza.plans.features import STATIC, build_features
from cadenza.schemas import FEATURE_COLUMNS

ANCHOR = date(2021, 1, 4)
TRACKS = "track_id string, popularity int, duration_ms long, danceability double, acousticness double, instrumentalness double, release_date string"


def catalogue(spark):
    return spark.createDataFrame([
        ("a", 10, 1000, 0.1, 0.2, 0.3, "1999-05"),
        ("b", 20, 2000, 0.4, None, 0.6, "n/a"),
        ("b", 20, 2000, 0.4, 0.9, 0.6, "n/a"),     # repeated id
        (None, 1, 1, 0.0, 0.0, 0.0, "2000"),       # no id
        ("quiet", 5, 500, 0.7, 0.8, 0.9, None),
    ], TRACKS)


EVENTS = [
    ("2021-01-05T10:00:00", 1, "a", "play"),       # week 1, incomplete
    ("2021-01-11T10:00:00", 1, "a", "play"), ("2021-01-11T10:00:00.5", 1, "a", "skip"),
    ("2021-01-12T10:00:00", 2, "a", "play"), ("2021-01-12T10:01:00", 2, "a", "like"),
    ("2021-01-13T10:00:00", 2, "gone", "play"),    # not in the catalogue
    ("2021-01-19T10:00:00", 2, None, "advertisement"),  # week 3 has only this
    (None, 2, "a", "play"),                        # no time: in no week
    ("2021-02-02T10:00:00", 2, "b", "play"),       # week 5; week 4 is missing
    ("2021-02-09T10:00:00", 2, "b", "play"),       # week 6, incomplete
]


def features(spark, make_log, **options):
    return build_features(make_log(EVENTS), catalogue(spark), ANCHOR, partial_weeks=[1, 6], **options)


def test_feature_table_by_hand(spark, make_log):
    df = features(spark, make_log)
    assert df.columns == FEATURE_COLUMNS
    got = {(r["track_id"], r["week"]): r for r in df.collect()}
    assert len(got) == df.count() == 3 * 4
    assert sorted({w for _, w in got}) == [2, 3, 5, 6]
    assert got["a", 2]["play_count"] == 2 and got["b", 5]["play_count"] == 1
    third = got["a", 3]
    assert (third["lag_1"], third["lag_like_count"], third["lag_skip_count"], third["lag_playtime_ratio"]) == (2, 1, 1, 0.75)
    # Lags go by row: week 5 follows week 3.
    assert got["a", 5]["lag_2"] == 2 and got["a", 6]["lag_3"] == 2 and got["b", 6]["lag_1"] == 1
    assert (got["a", 2]["release_date"], got["b", 2]["release_date"], got["quiet", 2]["release_date"]) == (1999, 0, 0)
    assert got["b", 2]["acousticness"] == 0.9
    assert all(got["quiet", w]["play_count"] == 0 for w in (2, 3, 5, 6))


def test_calendar_option_fills_missing_weeks(spark, make_log):
    got = {(r["track_id"], r["week"]): r["lag_3"] for r in features(spark, make_log, calendar=True).collect()}
    assert sorted({w for _, w in got}) == [2, 3, 4, 5, 6]
    assert got["a", 5] == 2


def test_one_plan_equals_the_steps(spark, make_log):
    tracks = p.with_release_year(catalogue(spark))
    log = p.with_week(p.drop_weeks(make_log(EVENTS), [1, 6], ANCHOR), ANCHOR)
    panel = p.left_join_measures(p.track_week_grid(tracks, log), p.weekly_event_counts(log))
    panel = p.left_join_measures(panel, p.mean_playtime(log, tracks))
    panel = p.lagged(p.append_future_week(panel, tracks), p.FEATURE_LAGS)
    steps = p.fill_zero(p.enrich_tracks(panel, tracks, STATIC)).select(*FEATURE_COLUMNS)
    assert rows(steps, "track_id", "week") == rows(features(spark, make_log), "track_id", "week")


def test_properties(spark, make_log):
    df = features(spark, make_log)
    known = {"a", "b"}
    plays = sum(1 for t, _, track, e in EVENTS[1:-1] if e == "play" and track in known and t is not None)
    assert df.agg(F.sum("play_count")).first()[0] == plays
    by_key = {(r["track_id"], r["week"]): r for r in df.collect()}
    weeks = sorted({w for _, w in by_key})
    for (track, week), row in by_key.items():
        at = weeks.index(week)
        for k in range(1, 6):
            assert row[f"lag_{k}"] == (by_key[track, weeks[at - k]]["play_count"] if at >= k else 0)


def test_drop_weeks_reaches_the_scan(spark, make_log, tmp_path):
    make_log(EVENTS).write.parquet(str(tmp_path / "log"))
    df = p.drop_weeks(spark.read.parquet(str(tmp_path / "log")), [1, 6], ANCHOR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(LessThan(timestamp" in plan
    assert df.count() == 7


def test_empty_log_gives_an_empty_panel(spark, make_log):
    assert build_features(make_log([]), catalogue(spark), ANCHOR, partial_weeks=[]).count() == 0


def test_weeks_outside_the_numbered_range_stay(spark, make_log):
    log = make_log([("2020-12-29T10:00:00", 1, "a", "play"), ("2021-01-05T10:00:00", 1, "a", "play")])
    weeks = [r["week"] for r in p.with_week(p.drop_weeks(log, [1], ANCHOR), ANCHOR).collect()]
    assert weeks == [0]


def test_plan_shuffles_no_grid_rows(spark, make_log):
    plan = features(spark, make_log)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Generate posexplode")[0]
    assert "Exchange" not in above and "Window" not in above and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
