"""Retrieval analytics over documents and source files, on Spark DataFrames."""
