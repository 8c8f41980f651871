"""Column expressions: text, identity, matching rules."""
