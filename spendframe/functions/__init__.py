"""Column expressions: exact money arithmetic, categories, parsing."""
