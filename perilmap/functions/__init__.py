"""Column expressions: text, taxonomy."""
