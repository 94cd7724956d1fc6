"""Change-history analytics on Spark DataFrames."""
