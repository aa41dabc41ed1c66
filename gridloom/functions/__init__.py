"""Column functions: scalars, vectors, matrices, colours, strings."""
