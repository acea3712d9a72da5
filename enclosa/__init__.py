"""Verified matrix analytics on Spark DataFrames."""
