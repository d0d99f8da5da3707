"""Column functions: text analysis, scoring, snippets."""
