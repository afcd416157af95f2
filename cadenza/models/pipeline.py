"""Feature vector, fitting, scoring, storing."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

from cadenza.operators.panel import fill_zero
from cadenza.schemas import MODEL_INPUTS


def assembler(inputs: list[str] | None = None) -> VectorAssembler:
    return VectorAssembler(inputCols=inputs or MODEL_INPUTS, outputCol="features")


def fit(estimator: Estimator, train: DataFrame, inputs: list[str] | None = None) -> PipelineModel:
    """Fit assembler and estimator on the columns they need; nulls count as 0."""
    inputs = inputs or MODEL_INPUTS
    rows = fill_zero(train.select(*inputs, estimator.getLabelCol()))
    return Pipeline(stages=[assembler(inputs), estimator]).fit(rows)


def score_batch(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add the feature vector and the prediction."""
    return model.transform(fill_zero(rows))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
