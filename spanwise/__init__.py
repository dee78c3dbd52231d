"""Interval-concurrency analytics on Spark DataFrames."""
