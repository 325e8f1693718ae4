"""Temporal map-feature analytics on Spark DataFrames."""
