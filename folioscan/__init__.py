"""Document retrieval analytics, planned as Spark DataFrames."""
