"""Weekly play-log analytics and top-list forecasting on Spark DataFrames."""
