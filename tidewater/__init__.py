"""Unified batch and stream analytics on Spark DataFrames."""
