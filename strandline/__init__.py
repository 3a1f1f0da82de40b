"""Corpus review, retrieval and event analytics on Spark DataFrames."""
