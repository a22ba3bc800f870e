"""Column functions over natural-language and SQL text."""
