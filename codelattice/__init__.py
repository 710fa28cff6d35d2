"""Repository-scale code analytics on Spark DataFrames."""
