"""Queries of the driver: operators applied to its tables, with their SQL."""
