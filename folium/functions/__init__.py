"""Column expressions: paths, lines, text."""
