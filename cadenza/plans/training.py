"""Train and evaluate: split, fit, score, metrics, NDCG, sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.models.pipeline import save_model, score_batch
from cadenza.operators.evaluation import mean_ndcg, regression_metrics, time_split
from cadenza.sources.writers import write_metrics, write_predictions_json


def evaluate(scored: DataFrame, k: int = 20) -> DataFrame:
    """Error metrics and mean NDCG@k in long form."""
    ndcg = mean_ndcg(scored, k).select(F.lit(f"ndcg@{k}").alias("metric"), F.col("mean_ndcg").alias("value"))
    return regression_metrics(scored).unionByName(ndcg)


def train_and_evaluate(
    features: DataFrame,
    train_model: Callable[[DataFrame], PipelineModel],
    train_up_to: int | None = None,
    test_weeks: list[int] | tuple[int, int] | None = None,
    output: str | None = None,
    k: int = 20,
) -> tuple[PipelineModel, DataFrame]:
    """Fit on the early weeks, score the test weeks; returns model and metrics.

    With `output` the predictions, model and metrics are written below it.
    """
    bounds = {"train_up_to": train_up_to, "test": test_weeks}
    # No validation weeks here: they must not take any of the test weeks.
    parts = time_split(features, validation=[], **{name: v for name, v in bounds.items() if v is not None})
    model = train_model(parts.filter("split = 'train'").drop("split"))
    scored = score_batch(model, parts.filter("split = 'test'").drop("split"))
    if output:
        # Written once, then read back: metrics do not score the rows again.
        write_predictions_json(scored, f"{output}/predictions")
        save_model(model, f"{output}/model")
        written = features.sparkSession.read.schema(
            "week bigint, play_count double, predicted_play_count double"
        ).json(f"{output}/predictions")
        write_metrics(evaluate(written, k), f"{output}/metrics")
        return model, features.sparkSession.read.schema("metric string, value double").json(f"{output}/metrics")
    return model, evaluate(scored, k)
