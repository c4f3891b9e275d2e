"""Stream and batch analytics on Spark DataFrames."""
