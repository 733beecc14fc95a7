"""Difference models as a stream of changes."""
