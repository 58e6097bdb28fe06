"""Document-layout analytics on Spark DataFrames."""
