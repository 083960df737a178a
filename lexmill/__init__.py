"""A document search and ranking engine on Spark DataFrames."""
