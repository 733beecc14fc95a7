"""Static checks of queries, updates and shapes against a schema index, without data."""
