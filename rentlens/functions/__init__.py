"""Column expressions: text helpers, parsing, place names, derived features."""
