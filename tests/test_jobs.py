import random
from datetime import date, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cadenza import models
from cadenza.models import trees
from cadenza.plans import toplist as tl
from cadenza.plans.correlation import correlation_report, listenability_cells, listenability_panel
from cadenza.plans.training import train_and_evaluate
from cadenza.schemas import FEATURES, MODEL_INPUTS, PREDICTION, TRACK_ATTRIBUTES
from cadenza.session import scratch_path


@pytest.fixture(scope="module")
def features(spark):
    """Plays follow last week's: play_count = 2 * lag_1 + 1."""
    data = []
    for week in range(7, 130):
        for i in range(8):
            lag = float((i * 7 + week * 3) % 11)
            data.append((f"t{i}", week, 1.0, 0.0, 0.5, lag, *[float((i + k * week) % 5) for k in range(2, 6)], i, 1990 + i, 1000 * i, 0.1 * i, 0.2, 0.3, 2 * lag + 1))
    return spark.createDataFrame(data, FEATURES).cache()


def test_linear_model_finds_the_rule(features):
    model, metrics = train_and_evaluate(features, models.train_linear, train_up_to=94, test_weeks=(100, 129))
    values = dict(rows(metrics))
    assert values["rmse"] == pytest.approx(0, abs=1e-6) and values["r2"] == pytest.approx(1)
    assert values["ndcg@20"] == pytest.approx(1)
    coefficients = dict(zip(MODEL_INPUTS, model.stages[-1].coefficients))
    assert coefficients["lag_1"] == pytest.approx(2)


def test_written_job_gives_the_same_metrics(spark, features):
    _, direct = train_and_evaluate(features, models.train_linear, test_weeks=(100, 129))
    path = scratch_path(spark, "job")
    _, written = train_and_evaluate(features, models.train_linear, test_weeks=(100, 129), output=path)
    for metric, value in rows(written):
        assert value == pytest.approx(dict(rows(direct))[metric], abs=1e-9)
    predictions = spark.read.json(f"{path}/predictions")
    assert predictions.count() == 30 * 8 and len(predictions.first()["features"]) == len(MODEL_INPUTS)


def test_model_survives_saving(spark, features):
    path = scratch_path(spark, "model")
    model = models.train_gbt(features, {"maxIter": 2, "maxDepth": 2})
    models.save_model(model, path)
    key = ["track_id", "week", PREDICTION]
    again = models.score_batch(models.load_model(path), features).select(*key)
    assert rows(again, "track_id", "week") == rows(models.score_batch(model, features).select(*key), "track_id", "week")


def test_ols_on_lags_and_single_lag(features):
    model = models.train_ols(features, ["lag_1", "lag_2", "lag_3"]).stages[-1]
    assert model.intercept == pytest.approx(1) and model.coefficients[0] == pytest.approx(2)
    line = models.ols_single_lag(features).first()
    assert (line["slope"], line["intercept"]) == (pytest.approx(2), pytest.approx(1))


def test_search_is_seeded_and_in_bounds(spark, features):
    points = trees.draw_params(trees.SEARCH_SPACE, 20, 1410)
    assert points == trees.draw_params(trees.SEARCH_SPACE, 20, 1410) and len(points) == 20
    for point in points:
        for name, choice in trees.SEARCH_SPACE.items():
            assert point[name] in choice if isinstance(choice, list) else choice[0] <= point[name] <= choice[1]
    train, check = features.filter("week <= 94"), features.filter("week > 100")
    table = models.tune_gbt(train, check, trials=2, space={"maxDepth": (1, 3)}, maxIter=2)
    errors = [r["mse"] for r in table.collect()]
    assert len(errors) == 2 and errors == sorted(errors)
    path = scratch_path(spark, "params")
    found = models.best_or_tuned(train, check, path, trials=1, space={"maxDepth": (1, 2)}, maxIter=2)
    assert models.best_or_tuned(train, check, path) == found == models.read_params(spark, path)


def test_request_checks():
    good = {"tracks_num": 3, "date": "2021-03-01"}
    assert tl.toplist_request(good) == {"tracks_num": 3, "week": 10, "model_type": "advanced"}
    for bad in (
        {"date": "2021-03-01"}, {"tracks_num": 3}, {**good, "tracks_num": 0}, {**good, "tracks_num": "3"},
        {**good, "tracks_num": True}, {**good, "date": 20210301}, {**good, "date": "2021-01-11"},
        {**good, "date": "March"}, {**good, "model_type": "best"},
    ):
        with pytest.raises(ValueError):
            tl.toplist_request(bad)


def test_toplist_orders_by_prediction_with_names(spark, features):
    tracks = spark.createDataFrame([(f"t{i}", f"Track {i}") for i in range(7)], "track_id string, name string")
    model = models.train_linear(features.filter("week <= 94"))
    day = (date(2020, 12, 28) + timedelta(weeks=99)).isoformat()
    job = tl.toplist_job({"tracks_num": 5, "date": day}, features, tracks, {"advanced": model})
    wanted = sorted(((-r["lag_1"], r["track_id"]) for r in features.filter("week = 100").collect()))[:5]
    got = rows(job, "rank")
    assert [g[1] for g in got] == [t for _, t in wanted]
    assert [g[0] for g in got] == [1, 2, 3, 4, 5]
    assert all(g[2] == (f"Track {g[1][1:]}" if g[1] != "t7" else None) for g in got)
    assert tl.toplist(features, tracks, 999, 5, model).count() == 0


def test_popular_tracks_side_by_side(features):
    scored = features.withColumn(PREDICTION, -F.col("play_count"))
    got = rows(tl.popular_tracks_report(scored, 50, "play_count", PREDICTION, 3), "rank")
    week = sorted((r["play_count"], r["track_id"]) for r in features.filter("week = 50").collect())
    assert [g[3] for g in got] == [t for _, t in week[:3]]
    assert [g[2] for g in got] == sorted((p for p, _ in week), reverse=True)[:3]


def test_correlation_report_against_pandas(spark, make_log):
    rng = random.Random(11)
    start = date(2021, 1, 4)
    events = [
        ((start + timedelta(days=rng.randint(0, 69))).isoformat() + f"T{rng.randint(0, 23):02d}:00:00", rng.randint(1, 5), f"t{rng.randint(0, 5)}", rng.choice(["play", "like", "skip"]))
        for _ in range(400)
    ]
    rows_ = [
        (f"t{i}", *[float((i * 3 + k * k) % 7) for k in range(len(TRACK_ATTRIBUTES) - 1)], str(1990 + i) if i != 4 else "n/a")
        for i in range(8)
    ]
    names = [c for c in TRACK_ATTRIBUTES if c != "release_date"]
    tracks = spark.createDataFrame(rows_, "track_id string, " + ", ".join(f"{c} double" for c in names) + ", release_date string")
    panel = listenability_panel(make_log(events), tracks, TRACK_ATTRIBUTES, start, [1, 10])
    cells = listenability_cells(make_log(events), tracks, TRACK_ATTRIBUTES, start, [1, 10])
    raw = panel.toPandas().sort_values(["track_id", "week"])
    raw["release_date"] = raw["release_date"].astype(float)
    full = raw.fillna(0)
    totals = full.groupby(["track_id", "active"]).agg({"listenability": "sum", **{c: "first" for c in TRACK_ATTRIBUTES}}).reset_index()
    measures = ["listenability", "lag_1", "lag_2", "lag_3", *TRACK_ATTRIBUTES]
    frames = {
        "all": full[measures], "warm": full[full.week > 4][measures], "active": full[full.active][measures],
        "active_warm": full[full.active & (full.week > 4)][measures], "with_week": full[["week", *measures]],
        "totals": totals[["listenability", *TRACK_ATTRIBUTES]],
        "totals_active": totals[totals.active][["listenability", *TRACK_ATTRIBUTES]],
        "with_parts": raw[["week", "play_count", "like_count", "playtime_ratio", *measures]],
    }
    got = {(r["variant"], r["attr_a"], r["attr_b"]): r["r"] for r in correlation_report(cells).collect()}
    assert len(got) == sum(len(f.columns) ** 2 for f in frames.values())
    for name, frame in frames.items():
        wanted = frame.astype(float).corr()
        for a in frame.columns:
            for b in frame.columns:
                value = got[name, a, b]
                assert (value is None and wanted.loc[a, b] != wanted.loc[a, b]) or value == pytest.approx(wanted.loc[a, b], abs=1e-9), (name, a, b)
