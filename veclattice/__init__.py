"""Multi-vector (late-interaction) search and its data processing on Spark DataFrames."""
