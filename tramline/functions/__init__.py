"""Column expressions: text, number, time and geometry helpers."""
