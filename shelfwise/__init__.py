"""Retail analytics jobs on Spark: every job takes and returns DataFrames."""
