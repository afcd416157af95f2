"""Trees learnt in blocks, held against MLlib's."""

import numpy as np
import pandas as pd
import pytest
from pyspark import StorageLevel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import functions as F

from cadenza import models
from cadenza.models import boosting, trees
from cadenza.models.pipeline import fit
from cadenza.schemas import LABEL, MODEL_INPUTS, PREDICTION
from cadenza.session import scratch_path


@pytest.fixture(scope="module")
def rows(spark):
    """Inputs with many values, few, one; a label that hangs on three of them, and noise that lets no two splits tie."""
    rnd = np.random.default_rng(4)
    n = 1500
    frame = pd.DataFrame({c: rnd.normal(size=n) for c in MODEL_INPUTS})
    frame["lag_1"] = rnd.integers(0, 5, n).astype(float)
    frame["lag_2"] = np.where(rnd.random(n) < 0.8, 0.0, rnd.integers(-3, 9, n))
    frame["lag_5"] = 7.0
    frame["popularity"] = rnd.integers(0, 100, n)
    frame[LABEL] = 3 * frame["lag_1"] + np.where(frame["lag_2"] > 2, 9.0, 0.0) + frame["popularity"] ** 2 / 500 + rnd.normal(size=n)
    return spark.createDataFrame(frame).repartition(3).persist(StorageLevel.MEMORY_ONLY)


def predictions(model, rows):
    return np.array([r[0] for r in models.score_batch(model, rows).orderBy("danceability").select(PREDICTION).collect()])


@pytest.mark.parametrize("params", [
    {"maxDepth": 5, "maxBins": 58, "maxIter": 4, "minInstancesPerNode": 8, "minInfoGain": 0.0004},
    {"maxDepth": 2, "maxBins": 16, "maxIter": 6, "stepSize": 0.3, "minInfoGain": 0.05},
    {"maxDepth": 0, "maxIter": 2},
    {"maxDepth": 4, "maxIter": 3, "minInstancesPerNode": 800},
])
def test_trees_equal_those_of_mllib(rows, monkeypatch, params):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 200)
    found = models.train_gbt(rows, params)
    wanted = fit(trees.gbt(params), rows)
    assert isinstance(wanted.stages[-1], GBTRegressionModel) and isinstance(found.stages[-1], boosting.BoostedTrees)
    assert predictions(found, rows) == pytest.approx(predictions(wanted, rows), abs=1e-9)


def test_levels_may_take_several_passes(rows, monkeypatch):
    params = {"maxDepth": 3, "maxIter": 2, "subsamplingRate": 0.7, "featureSubsetStrategy": "sqrt"}
    one = predictions(models.train_gbt(rows, params), rows)
    monkeypatch.setattr(boosting, "HISTOGRAM_BYTES", 1)
    assert predictions(models.train_gbt(rows, params), rows) == pytest.approx(one, abs=1e-9)


def test_each_tree_learns_from_its_share_of_the_rows(rows):
    params = {"maxDepth": 2, "maxIter": 3, "subsamplingRate": 0.5}
    whole = predictions(models.train_gbt(rows, {**params, "subsamplingRate": 1.0}), rows)
    one, again, other = (predictions(models.train_gbt(rows, params, seed), rows) for seed in (1, 1, 2))
    assert (one == again).all() and (one != other).any() and (one != whole).any()
    labels = np.array([r[0] for r in rows.orderBy("danceability").select(LABEL).collect()])
    assert ((one - labels) ** 2).mean() < 1.3 * ((whole - labels) ** 2).mean() < 0.6 * labels.var()


def test_trees_survive_saving_and_gaps(spark, rows):
    model = models.train_gbt(rows, {"maxDepth": 3, "maxIter": 2})
    path = scratch_path(spark, "boosted")
    models.save_model(model, path)
    assert (predictions(models.load_model(path), rows) == predictions(model, rows)).all()
    gaps = rows.withColumn("lag_1", F.when(F.col("lag_1") > 1, F.col("lag_1")))
    zeros = rows.withColumn("lag_1", F.when(F.col("lag_1") > 1, F.col("lag_1")).otherwise(0.0))
    assert (predictions(models.load_model(path), gaps) == predictions(model, zeros)).all()


def test_a_search_measures_the_model_that_training_gives(rows):
    space = {"maxDepth": (1, 3), "maxBins": (4, 40), "subsamplingRate": (1.0, 1.0), "featureSubsetStrategy": ["all"]}
    train, check = rows.filter("danceability < 0.5"), rows.filter("danceability >= 0.5")
    found = {r["trial"]: r["mse"] for r in models.tune_gbt(train, check, trials=2, space=space, maxIter=2).collect()}
    for trial, point in enumerate(trees.draw_params({**trees.SEARCH_SPACE, **space}, 2, trees.SEED)):
        scored = models.score_batch(fit(trees.gbt({**point, "maxIter": 2}), train), check)
        assert found[trial] == pytest.approx(scored.agg(F.avg((F.col(LABEL) - F.col(PREDICTION)) ** 2)).first()[0], abs=1e-9)


def test_other_losses_are_left_to_mllib(rows):
    assert isinstance(models.train_gbt(rows, {"maxIter": 1, "maxDepth": 1, "lossType": "absolute"}).stages[-1], GBTRegressionModel)
    with pytest.raises(ValueError):
        models.train_gbt(rows.limit(0))


def test_thresholds_of_long_columns_deal_rows_out_evenly():
    values = np.concatenate([np.zeros(5000), np.arange(5000) / 10])
    found = boosting.cuts(values, 11)
    assert len(found) <= 10 and found[0] > 0 and (np.diff(found) > 0).all()
    assert boosting.cuts(np.array([-0.0, 0.0, 2.0, 2.0]), 5).tolist() == [1.0] and not len(boosting.cuts(np.ones(9), 5))
