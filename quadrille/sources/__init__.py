"""Readers: grid-model RDF/XML, N-Triples and N-Quads, Turtle and TriG, file patterns, JSON with comments, SPARQL over HTTP."""
