"""Statistical transformation and validation on Spark DataFrames."""
