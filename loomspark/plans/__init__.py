"""Assembled queries."""
