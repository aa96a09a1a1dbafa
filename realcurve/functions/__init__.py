"""Column functions and ordered-series idioms."""
