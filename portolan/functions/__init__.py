"""Column expressions: cleaning, identifiers, text, scoring."""
