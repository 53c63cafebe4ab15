"""Access-log analytics on Spark DataFrames."""
