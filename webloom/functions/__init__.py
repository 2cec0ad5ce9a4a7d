"""Column expressions: URLs, text, scores."""
