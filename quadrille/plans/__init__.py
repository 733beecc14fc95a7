"""SPARQL: parser, algebra and the compiler to DataFrame plans."""
