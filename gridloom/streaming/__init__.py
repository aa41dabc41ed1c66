"""Structured Streaming on grids."""
