"""Operators: each is a function from DataFrames (plus small parameters) to a DataFrame."""
