"""Column functions: text, measures, addresses."""
