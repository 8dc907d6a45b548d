"""Transcript analytics on Spark: ordered, timed text as DataFrames."""
