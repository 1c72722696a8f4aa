"""Operators on DataFrames; every key, value and partition column is an argument."""
