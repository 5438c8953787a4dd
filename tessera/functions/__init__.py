"""Column expressions: text, numbers, dates, verification and vectors."""
