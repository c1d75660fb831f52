"""Passage store, retrieval and training-data operators on Spark DataFrames."""
