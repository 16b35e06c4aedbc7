"""Transit analytics on Spark DataFrames."""
