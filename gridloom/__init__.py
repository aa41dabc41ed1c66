"""Sparse grids and attributed points as Spark DataFrames."""
