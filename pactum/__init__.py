"""Contract-driven data jobs on Spark DataFrames."""
