"""Column expressions: cleaning rules, bands, rates and intervals."""
