"""Paired-evaluation analytics on Spark DataFrames."""
