from cadenza.models.linear import ols_single_lag, train_linear, train_ols
from cadenza.models.pipeline import load_model, save_model, score_batch
from cadenza.models.trees import best_or_tuned, read_params, train_gbt, tune_gbt, write_params

__all__ = [
    "best_or_tuned", "load_model", "ols_single_lag", "read_params", "save_model", "score_batch",
    "train_gbt", "train_linear", "train_ols", "tune_gbt", "write_params",
]
