"""Operators on catalogues; each is a function from DataFrames to a DataFrame."""
