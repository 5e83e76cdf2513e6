"""Industrial-history analytics on Spark DataFrames."""
