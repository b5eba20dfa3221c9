"""Incremental processing: append-only results that resume where they stopped."""
