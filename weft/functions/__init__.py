"""Column builders and small helpers."""
