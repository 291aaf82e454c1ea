"""Commerce growth analytics as lazy Spark DataFrames."""
