"""Developer-activity analytics on Spark DataFrames."""
