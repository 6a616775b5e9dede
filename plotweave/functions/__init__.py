"""Column expressions and similarity functions."""
