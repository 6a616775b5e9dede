"""Narrative-continuity analytics on Spark DataFrames."""
