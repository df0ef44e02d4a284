"""Warehouse profiling and semantic-layer engine on Spark DataFrames."""
