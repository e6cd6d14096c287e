"""Column expressions: text, time, location and quality rules. No Python UDFs."""
