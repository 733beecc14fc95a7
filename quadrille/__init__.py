"""RDF graph queries, grid-model files and validation on PySpark DataFrames."""
