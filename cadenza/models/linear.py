"""Linear regressors."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.models.pipeline import fit
from cadenza.schemas import LABEL, PREDICTION


def train_linear(train: DataFrame, inputs: list[str] | None = None) -> PipelineModel:
    """Linear regression with MLlib's defaults."""
    return fit(LinearRegression(labelCol=LABEL, predictionCol=PREDICTION), train, inputs)


def train_ols(train: DataFrame, inputs: list[str], label: str = LABEL) -> PipelineModel:
    """Ordinary least squares by normal equations: one aggregation over the rows."""
    ols = LinearRegression(labelCol=label, predictionCol=PREDICTION, regParam=0.0, solver="normal")
    return fit(ols, train, inputs)


def ols_single_lag(train: DataFrame, lag: str = "lag_1", label: str = LABEL) -> DataFrame:
    """Slope and intercept of the label on one lag, as one row."""
    return train.agg(
        F.regr_slope(label, lag).alias("slope"),
        F.regr_intercept(label, lag).alias("intercept"),
        F.regr_count(label, lag).alias("n"),
    )
