"""Column expressions: numeric cleaning, geography, road model, text, cell parsing."""
