"""Writers: grid-model RDF/XML, SPARQL results, Turtle, Markdown, findings."""
