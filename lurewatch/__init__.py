"""URL-threat analytics on Spark DataFrames."""
