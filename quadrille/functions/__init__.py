"""SPARQL scalar functions and aggregates as Spark columns."""
