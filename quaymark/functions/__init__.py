"""Column functions: no Python runs for a row."""
