"""Training-data operators: one module for each, with its query and SQL.

Nothing else in the library imports this subpackage.
"""
