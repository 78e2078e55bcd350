"""Column functions and plan helpers."""
