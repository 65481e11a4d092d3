"""Alignment analytics over ordered observations, and preparation of training text, on Spark DataFrames."""
