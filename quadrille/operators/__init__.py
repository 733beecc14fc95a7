"""Operators on relations and graphs: joins, paths, deltas, difference models."""
