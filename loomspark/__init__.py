"""loomspark: corpus curation operators declared with the PySpark DataFrame API."""
