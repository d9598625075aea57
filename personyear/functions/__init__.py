"""Column expressions: text, numbers, years, names, label classifiers, similarity."""
