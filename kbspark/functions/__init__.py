"""Column expressions: parsing, normalising and tokenising text."""
