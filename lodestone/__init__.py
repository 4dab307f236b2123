"""Search-index analytics as plain Spark DataFrames."""
