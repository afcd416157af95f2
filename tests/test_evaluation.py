import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.ml.evaluation import RegressionEvaluator

from cadenza.operators import evaluation as ev

SCORED = "week long, track_id string, play_count double, predicted_play_count double"


def brute_ndcg(gain, score, k):
    """By definition: gain of equal scores is averaged over the places they take."""
    gain, score = np.array(gain), np.array(score)
    discount = np.array([1 / math.log2(i + 2) if i < k else 0.0 for i in range(len(gain))])
    order = np.argsort(-score, kind="stable")
    dcg, at = 0.0, 0
    for value in sorted(set(score), reverse=True):
        members = gain[score == value]
        dcg += members.mean() * discount[at:at + len(members)].sum()
        at += len(members)
    ideal = (np.sort(gain)[::-1] * discount).sum()
    assert len(order) == at
    return dcg / ideal if ideal else 0.0


@pytest.mark.parametrize("k", [1, 3, 20])
def test_ndcg_against_the_definition(spark, k):
    rng = random.Random(k)
    weeks = {
        w: [(float(rng.randint(0, 4)), float(rng.choice([0, 0, 0, 1, 2, rng.random()]))) for _ in range(rng.randint(1, 40))]
        for w in range(1, 9)
    }
    weeks[99] = [(0.0, 1.0), (0.0, 0.5)]
    data = [(w, str(i), g, s) for w, cells in weeks.items() for i, (g, s) in enumerate(cells)]
    got = {r["week"]: r["ndcg"] for r in ev.ndcg_at_k(spark.createDataFrame(data, SCORED), k).collect()}
    assert got.keys() == weeks.keys()
    for week, cells in weeks.items():
        assert got[week] == pytest.approx(brute_ndcg(*zip(*cells), k), abs=1e-12)
        assert 0 <= got[week] <= 1 + 1e-12
    assert got[99] == 0


def test_perfect_scores_give_one(spark):
    df = spark.createDataFrame([(1, str(i), float(i % 5), float(i % 5)) for i in range(30)], SCORED)
    assert ev.mean_ndcg(df, 10).first()[0] == pytest.approx(1.0)


def test_metrics_match_the_evaluator(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(1, str(i), float(rng.randint(0, 9)), rng.random() * 9) for i in range(200)], SCORED)
    got = dict(rows(ev.regression_metrics(df)))
    for metric, value in got.items():
        evaluator = RegressionEvaluator(labelCol="play_count", predictionCol="predicted_play_count", metricName=metric)
        assert value == pytest.approx(evaluator.evaluate(df), rel=1e-9)
    assert got["mse"] == pytest.approx(got["rmse"] ** 2)


def test_constant_label_has_no_r2(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 1.0), (1, "b", 2.0, 3.0)], SCORED)
    assert dict(rows(ev.regression_metrics(df))) == {"rmse": 1.0, "mae": 1.0, "mse": 1.0, "r2": None}


def test_split_takes_members_or_ranges(spark):
    df = spark.createDataFrame([(w,) for w in (94, 95, 100, 125, 126, 130, 157, 158)], "week long")
    got = {r["week"]: r["split"] for r in ev.time_split(df).collect()}
    assert got == {94: "train", 95: "validation", 100: None, 125: "validation", 126: "test", 130: None, 157: "test", 158: None}
    ranged = {r["week"]: r["split"] for r in ev.time_split(df, validation=(95, 125), test=(126, 157)).collect()}
    assert ranged[100] == "validation" and ranged[130] == "test" and ranged[158] is None


@pytest.mark.parametrize("k", [1001, 5000])
def test_ndcg_of_long_lists(spark, k):
    rng = random.Random(k)
    cells = [(float(rng.randint(0, 4)), rng.random()) for _ in range(6000)]
    df = spark.createDataFrame([(1, str(i), g, s) for i, (g, s) in enumerate(cells)], SCORED)
    assert ev.ndcg_at_k(df, k).first()["ndcg"] == pytest.approx(brute_ndcg(*zip(*cells), k))


def test_only_the_best_scores_of_a_week_are_handed_on(spark):
    rng = random.Random(5)
    cells = [(w, float(rng.randint(0, 3)), rng.random()) for w in (1, 2) for _ in range(3000)]
    df = spark.createDataFrame([(w, str(i), g, s) for i, (w, g, s) in enumerate(cells)], SCORED).repartition(3)
    result = ev.ndcg_at_k(df, 4)
    got = {r["week"]: r["ndcg"] for r in result.collect()}
    for week in (1, 2):
        assert got[week] == pytest.approx(brute_ndcg(*zip(*[(g, s) for w, g, s in cells if w == week]), 4))
    plan = result._jdf.queryExecution().executedPlan().toString()
    before_shuffles = ev._best_scores(4)
    batch = df.filter("week = 1").selectExpr(
        "false AS no_week", "week", "predicted_play_count AS dcg", "1 AS dcg_kind", "play_count AS ideal", "1 AS ideal_kind",
        "play_count AS gain", "1L AS gains", "0L AS unclear").toPandas()
    handed_on = list(before_shuffles([batch, batch]))
    assert sum(len(part) for part in handed_on) <= 2 * 4 and "MapInPandas" in plan


def test_ndcg_of_nulls_and_nan(spark):
    nan = float("nan")
    df = spark.createDataFrame([
        (1, "a", 2.0, nan), (1, "b", 1.0, 5.0), (1, "c", 4.0, None), (None, "d", 3.0, 1.0), (None, "e", None, 2.0),
        (2, "f", nan, 1.0), (2, "g", 1.0, 0.0), (3, "h", 1.0, -0.0), (3, "i", 3.0, 0.0)], SCORED)
    got = {r["week"]: r["ndcg"] for r in ev.ndcg_at_k(df, 2).collect()}
    assert got[1] == pytest.approx((2 + 1 / math.log2(3)) / (4 + 2 / math.log2(3)))  # NaN first, null last
    assert got[None] == pytest.approx((3 / math.log2(3)) / 3)
    assert math.isnan(got[2])
    assert got[3] == pytest.approx(2 * (1 + 1 / math.log2(3)) / (3 + 1 / math.log2(3)))  # the zeros are one score


@pytest.mark.parametrize("k", [1, 4, 200])
def test_rows_below_what_a_task_holds_change_nothing(spark, k, monkeypatch):
    monkeypatch.setattr(ev, "HELD", 100)
    rng = random.Random(k)
    cells = [(rng.choice([1, 2, 7]), float(rng.randint(0, 5)), round(rng.random(), 2)) for _ in range(3000)]
    df = spark.createDataFrame([(w, str(i), g, s) for i, (w, g, s) in enumerate(cells)], SCORED).repartition(2)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        got = {r["week"]: r["ndcg"] for r in ev.ndcg_at_k(df, k).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for week in (1, 2, 7):
        assert got[week] == pytest.approx(brute_ndcg(*zip(*[(g, s) for w, g, s in cells if w == week]), k))
