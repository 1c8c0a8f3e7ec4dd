"""Column expressions: parsing, labels, hashing, formatting."""
