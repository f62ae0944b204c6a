"""Graph-retrieval analytics on Spark: DataFrames in, DataFrames out."""
