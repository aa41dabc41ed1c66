"""Operators on grids and points, each a function from DataFrames to a DataFrame."""
