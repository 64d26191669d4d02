"""Column expressions: URLs, text, markup, keys."""
