"""Survival analytics and cross-fitting on Spark DataFrames."""
