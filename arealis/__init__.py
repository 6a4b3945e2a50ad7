"""Spatial and space-time analytics over Spark DataFrames."""
