"""Column expressions: names, paths, times and values."""
