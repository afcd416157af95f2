"""Top lists for a week."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.calendar import DEFAULT_ANCHOR, week_number
from cadenza.models.pipeline import score_batch
from cadenza.operators.ranking import top_n
from cadenza.schemas import PREDICTION
from cadenza.session import materialized

# Accepted model names and the first week a list is made for.
# (With week 1 dropped as incomplete, all five lags exist from week 7 on.)
MODEL_TYPES = ["basic", "advanced"]
DEFAULT_MODEL_TYPE = "advanced"
FIRST_WEEK = 6


def toplist_request(arguments: dict, anchor: date = DEFAULT_ANCHOR) -> dict:
    """Check job arguments {tracks_num, date, model_type?}; raises ValueError."""
    if not {"tracks_num", "date"} <= arguments.keys():
        raise ValueError("tracks_num and date are required")
    tracks_num, day = arguments["tracks_num"], arguments["date"]
    model_type = arguments.get("model_type", DEFAULT_MODEL_TYPE)
    if type(tracks_num) is not int or tracks_num < 1:
        raise ValueError("tracks_num must be a whole number above 0")
    if not isinstance(day, str):
        raise ValueError("date must be a string")
    if model_type not in MODEL_TYPES:
        raise ValueError(f"model_type must be one of {MODEL_TYPES}")
    week = week_number(day, anchor)
    if week < FIRST_WEEK:
        raise ValueError(f"the first week with a list is {FIRST_WEEK}")
    return {"tracks_num": tracks_num, "week": week, "model_type": model_type}


def toplist(
    features: DataFrame,
    tracks: DataFrame,
    week: int,
    n: int,
    predictor: PipelineModel | Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """rank, track_id, name and predicted plays of a week's n best tracks.

    `predictor` is a fitted model or a function that adds the prediction
    column.  The week is scored once and its n best rows are kept; a semi
    join then reduces the catalogue to the listed tracks.
    """
    score = (lambda df: score_batch(predictor, df)) if isinstance(predictor, PipelineModel) else predictor
    scored = score(features.filter(F.col("week") == week))
    best = materialized(top_n(scored.select("track_id", PREDICTION), PREDICTION, n), "toplist")
    names = (
        tracks.select("track_id", "name")
        .join(best.select("track_id"), "track_id", "left_semi")
        .groupBy("track_id")
        .agg(F.min("name").alias("name"))
    )
    return best.join(names, "track_id", "left").select("rank", "track_id", "name", PREDICTION)


def toplist_job(
    arguments: dict,
    features: DataFrame,
    tracks: DataFrame,
    models: dict[str, PipelineModel],
    anchor: date = DEFAULT_ANCHOR,
) -> DataFrame:
    """Top list from checked arguments and the models by type."""
    request = toplist_request(arguments, anchor)
    return toplist(features, tracks, request["week"], request["tracks_num"], models[request["model_type"]])


def popular_tracks_report(scored: DataFrame, week: int, label: str, prediction: str, n: int = 20) -> DataFrame:
    """Real and predicted top n of a week side by side."""
    rows = scored.filter(F.col("week") == week)
    real = top_n(rows.select("track_id", label), label, n).select(
        "rank", F.col("track_id").alias("real_track_id"), F.col(label).alias("real_value")
    )
    predicted = top_n(rows.select("track_id", prediction), prediction, n).select(
        "rank", F.col("track_id").alias("predicted_track_id"), F.col(prediction).alias("predicted_value")
    )
    return real.join(predicted, "rank", "full")
