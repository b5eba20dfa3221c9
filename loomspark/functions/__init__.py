"""Column expressions: text normalisation, similarity, reproducible draws."""
