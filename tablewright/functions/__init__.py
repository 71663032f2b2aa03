"""Column functions: text, numbers and identifiers of web tables."""
