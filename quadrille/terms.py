"""RDF terms, vocabularies and the column form of a term.

A term column is ``STRUCT<k TINYINT, v STRING, dt STRING, lang STRING>``: k is 1
for an IRI, 2 for a blank node, 3 for a literal; an unbound variable is a null
struct. Plain literals have the datatype xsd:string, tagged ones rdf:langString.
"""

from __future__ import annotations

from dataclasses import dataclass

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"
MD = "http://iec.ch/TC57/61970-552/ModelDescription/1#"
DM = "http://iec.ch/TC57/61970-552/DifferenceModel/1#"

RDF_TYPE = RDF + "type"
STRING, LANG_STRING = XSD + "string", RDF + "langString"
INTEGER, DECIMAL, DOUBLE, FLOAT = XSD + "integer", XSD + "decimal", XSD + "double", XSD + "float"
BOOLEAN, DATETIME, DATE = XSD + "boolean", XSD + "dateTime", XSD + "date"

#: Datatypes derived from xsd:integer.
INTEGERS = frozenset(XSD + n for n in "integer long int short byte nonNegativeInteger nonPositiveInteger negativeInteger positiveInteger unsignedLong unsignedInt unsignedShort unsignedByte".split())
NUMERIC = INTEGERS | {DECIMAL, DOUBLE, FLOAT}

IRI_KIND, BNODE_KIND, LITERAL_KIND = 1, 2, 3
TERM_TYPE = "struct<k:tinyint,v:string,dt:string,lang:string>"
QUAD_TYPE = f"g string, s string, p string, o {TERM_TYPE}"


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class BNode:
    label: str


@dataclass(frozen=True)
class Literal:
    value: str
    dt: str = STRING
    lang: str | None = None


Term = Iri | BNode | Literal


def term_tuple(t: Term) -> tuple:
    """The (k, v, dt, lang) row of a term."""
    if isinstance(t, Iri):
        return (IRI_KIND, t.value, None, None)
    if isinstance(t, BNode):
        return (BNODE_KIND, t.label, None, None)
    return (LITERAL_KIND, t.value, t.dt, t.lang)


def node_string(t: Term) -> str:
    """Subjects, predicates and graph names as strings; blank nodes begin with ``_:``."""
    return f"_:{t.label.removeprefix('_:')}" if isinstance(t, BNode) else t.value
