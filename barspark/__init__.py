"""Market-style time-series analytics on Spark DataFrames."""
