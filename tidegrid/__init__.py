"""Panel forecasting analytics on Spark: DataFrames in, DataFrames out."""
