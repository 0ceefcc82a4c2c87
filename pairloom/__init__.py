"""All pairs of similar vectors on Spark DataFrames."""
