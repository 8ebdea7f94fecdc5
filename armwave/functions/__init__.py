"""Column functions and small distribution helpers."""
