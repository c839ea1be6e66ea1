"""Trace analytics and large-scale data preparation on Spark DataFrames."""
