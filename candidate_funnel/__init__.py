"""Keyed candidate funnels on Spark DataFrames."""
