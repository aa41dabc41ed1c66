"""Where grids and points come from: tables, generators, Parquet."""
