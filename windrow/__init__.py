"""Ordered-event anomaly analytics on Spark DataFrames."""
