from cadenza.sources.cache import cached_dimension, release_dimensions
from cadenza.sources.readers import read_csv, read_features, read_history, read_jsonl
from cadenza.sources.writers import (
    jsonl_to_csv,
    rows_as_json,
    write_csv,
    write_features,
    write_histories,
    write_jsonl,
    write_metrics,
    write_predictions_json,
)

__all__ = [
    "cached_dimension", "read_history", "release_dimensions", "write_histories",
    "jsonl_to_csv", "read_csv", "read_features", "read_jsonl", "rows_as_json", "write_csv",
    "write_features", "write_jsonl", "write_metrics", "write_predictions_json",
]
