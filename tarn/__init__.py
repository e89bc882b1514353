"""Surface-water terrain analytics on Spark DataFrames."""
