"""Static checks of queries and shapes."""

import json

import pytest

from quadrille.checks.model import Finding, Schema, adjust, frame
from quadrille.checks.queries import QueryChecker, dependencies, infer_scope, inject_prefixes, split_queries
from quadrille.checks.shapes import ShapeChecker
from quadrille.schema_index import SchemaIndex
from quadrille.sinks import findings as sink
from quadrille.sources.text import turtle

SCHEMA = """@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
@prefix cims: <http://iec.ch/TC57/1999/rdf-schema-extensions-19990926#> . @prefix : <http://s/> .
:Thing a rdfs:Class . :Device a rdfs:Class ; rdfs:subClassOf :Thing . :Cable a rdfs:Class ; rdfs:subClassOf :Device . :Site a rdfs:Class ; rdfs:subClassOf :Thing . :Color a rdfs:Class . :red a :Color . :blue a :Color .
:name a rdf:Property ; rdfs:domain :Thing ; rdfs:range xsd:string . :length a rdf:Property ; rdfs:domain :Cable ; rdfs:range xsd:double ; cims:multiplicity <http://iec.ch/TC57/1999/rdf-schema-extensions-19990926#M:0..1> .
:at a rdf:Property ; rdfs:domain :Device ; rdfs:range :Site . :color a rdf:Property ; rdfs:domain :Device ; rdfs:range :Color . :area a rdf:Property ; rdfs:domain :Site ; rdfs:range xsd:double ."""


@pytest.fixture(scope="module")
def schema(spark):
    return Schema.of(SchemaIndex.of({"http://prof/1": turtle(spark, SCHEMA).default_graph()}))


P = "PREFIX : <http://s/> "
CASES = [
    ("SELECT ?x WHERE { ?x a :Cable ; :name ?n FILTER(?n = 'a') }", set()),
    ("SELECT ?x WHERE { ?x a :Nope }", {"UNKNOWN_CLASS"}),
    ("SELECT ?x WHERE { ?x :nope ?x }", {"UNKNOWN_PROPERTY"}),
    ("SELECT ?x WHERE { ?x rdfs:lable ?x }", {"UNKNOWN_VOCABULARY_TERM"}),
    ("SELECT ?x WHERE { ?x a :red }", {"ENUM_USED_AS_CLASS"}),
    ("SELECT ?x WHERE { ?x ?p ?x . ?p a ?c FILTER(?c = ?p) }", {"DYNAMIC_PREDICATE", "DYNAMIC_CLASS"}),
    ("SELECT ?x WHERE { ?x a :Site ; :length 5.0 }", {"PROPERTY_NOT_ALLOWED_FOR_CLASS"}),
    ("SELECT ?x WHERE { { ?x a :Site } UNION { ?x :length 5.0 } }", {"QUERY_IMPLIED_TYPE"}),
    ("SELECT ?x WHERE { ?x a :Cable ; :length 'long' }", {"DATATYPE_MISMATCH"}),
    ("SELECT ?x WHERE { ?x a :Cable ; :length 3 }", set()),
    ("SELECT ?x WHERE { ?x a :Cable ; :color :green }", {"INVALID_ENUM_VALUE"}),
    ("SELECT ?x WHERE { ?x a :Cable ; :color ?c FILTER(?c IN (:red, :green)) }", {"INVALID_ENUM_VALUE"}),
    ("SELECT ?x WHERE { ?x a :Cable ; :at/:area 5.0 }", set()),
    ("SELECT ?x WHERE { ?x a :Cable ; :color/:area 5.0 }", {"PATH_CHAIN_MISMATCH"}),
    ("SELECT ?x ?l WHERE { ?x a :Cable ; :length ?l }", {"PROPERTY_MAY_BE_ABSENT"}),
    ("SELECT ?x ?l WHERE { ?x a :Cable OPTIONAL { ?x :length ?l } }", set()),
    ("SELECT ?x WHERE { ?x a ?t FILTER(?t = :Nope) }", {"DYNAMIC_CLASS", "UNKNOWN_TERM_IN_EXPRESSION"}),
    ("SELECT ?x ?y WHERE { ?x a :Cable }", {"UNBOUND_PROJECTION"}),
    ("SELECT ?x WHERE { ?x a :Cable ; :name ?n }", {"UNUSED_VARIABLE"}),
    ("SELECT ?x WHERE { ?x a :Cable ", {"SYNTAX_ERROR"}),
    ("INSERT DATA { <http://a/1> a :Nope }", {"UNKNOWN_CLASS"}),
]


@pytest.mark.parametrize(("query", "codes"), CASES)
def test_query_codes(schema, query, codes):
    assert {f.code for f in QueryChecker(schema).check(P + query)} == codes


def test_scope_graphs_and_positions(schema):
    q = P + "SELECT ?x WHERE { GRAPH <http://g/1> { ?x a :Cable } GRAPH <http://g/2> { ?x a :Site } }"
    found = QueryChecker(schema, graphs={"http://g/1": {"http://prof/1"}}).check(q)
    assert {f.code for f in found} == {"GRAPH_NOT_CONFIGURED", "UNKNOWN_CLASS"}
    assert next(f for f in found if f.code == "UNKNOWN_CLASS").elsewhere == ("http://prof/1",)
    f = QueryChecker(schema).check(P + "\nSELECT ?x WHERE {\n  ?x a :Nope }")[0]
    assert (f.line, f.column) == (3, 8)
    injected, lines = inject_prefixes("SELECT * { ?x rdf:type xsd:string }")
    assert lines == 2 and injected.startswith("PREFIX rdf:")
    assert QueryChecker(schema).check("SELECT ?x {\n ?x rdf:type rdfs:Klass }")[0].line == 2


def test_many_queries_and_dependencies(schema):
    text = P + "SELECT ?x { ?x a :Cable }\n;\nSELECT ?x { ?x a :Nope }"
    assert len(split_queries(text)) == 2
    assert [f.code for f in QueryChecker(schema).check(text)] == ["UNKNOWN_CLASS"]
    d = dependencies(P + "SELECT ?x { GRAPH <http://g/1> { ?x a :Cable ; :at/:area ?y } }", schema)
    assert d == {"profiles": {"http://prof/1"}, "classes": {"http://s/Cable"}, "properties": {"http://s/at", "http://s/area"}, "graphs": {"http://g/1"}}
    assert infer_scope("SELECT * { ?s ?p ?o }", schema) == {"http://prof/1"}


def test_severities_and_sinks(spark):
    fs = [Finding("UNKNOWN_CLASS", "m", "t", 2, 3), Finding("QUERY_IMPLIED_TYPE", "h"), Finding("DATATYPE_MISMATCH", "w")]
    assert [f.severity for f in adjust(fs, {"QUERY_IMPLIED_TYPE": "OFF"})] == ["ERROR", "WARNING"]
    assert [f.severity for f in adjust(fs, strictness="strict")] == ["ERROR", "HINT", "ERROR"]
    assert [f.severity for f in adjust(fs, strictness="lenient")] == ["WARNING", "WARNING"]
    assert "q.rq:2:3: error: m [UNKNOWN_CLASS]" in sink.text({"q.rq": fs})
    assert json.loads(sink.as_json({"q": fs}))["files"][0]["findings"][0]["code"] == "UNKNOWN_CLASS"
    assert json.loads(sink.code_quality({"q": fs}))[0]["severity"] == "major"
    assert (sink.exit_code({"q": fs}), sink.exit_code({"q": fs[1:]}), sink.exit_code({}, True)) == (1, 0, 2)
    assert frame(spark, fs).count() == 3


H = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix : <http://s/> . @prefix x: <http://x/> . "
SHAPE_CASES = [
    ("x:S sh:targetClass :Cable ; sh:property [ sh:path :name ; sh:minCount 1 ; sh:datatype xsd:string ] .", set()),
    ("x:S sh:targetClass :Nope .", {"SHAPE_UNKNOWN_CLASS"}),
    ("x:S sh:property [ sh:path ( :at :nope ) ] .", {"SHAPE_UNKNOWN_PROPERTY"}),
    ("x:S sh:property [ sh:path [ sh:alternativePath ( :at :nope ) ] ] .", set()),
    ("x:S sh:property [ sh:path :name ; sh:nodeKind sh:IRI ] .", {"SHAPE_NODE_KIND_MISMATCH"}),
    ("x:S sh:property [ sh:path :name ; sh:datatype xsd:double ] .", {"SHAPE_DATATYPE_MISMATCH"}),
    ("x:S sh:property [ sh:path :at ; sh:class :Cable ] .", {"SHAPE_CLASS_MISMATCH"}),
    ("x:S sh:property [ sh:path :name ; sh:minCount 3 ; sh:maxCount 2 ] .", {"SHAPE_CARDINALITY_CONTRADICTION"}),
    ("x:S sh:property [ sh:path :name ; sh:minCount -1 ] .", {"SHAPE_INVALID_PARAMETER"}),
    ("x:S sh:property [ sh:path :length ; sh:minCount 2 ] .", {"SHAPE_CARDINALITY_EXCEEDS_SCHEMA"}),
    ("x:S sh:property [ sh:path :length ; sh:minInclusive 5 ; sh:maxExclusive 5 ] .", {"SHAPE_RANGE_CONTRADICTION"}),
    ("x:S sh:property [ sh:path :color ; sh:in ( :red :green ) ] .", {"SHAPE_INVALID_ENUM_VALUE"}),
    ("x:S sh:property [ sh:path x:none ; sh:datatype xsd:strnig ] .", {"SHAPE_UNKNOWN_PROPERTY", "SHAPE_UNKNOWN_DATATYPE"}),
    ("x:S sh:targetSubjectsOf :nope .", {"SHAPE_UNKNOWN_PROPERTY"}),
    ("x:S rdfs:lable 'x' .", {"SHAPE_UNKNOWN_VOCABULARY_TERM"}),
    ("x:S sh:targetClass :Nope ; sh:deactivated true ; sh:property x:P . x:P sh:path :nope .", set()),
    ("x:S sh:targetClass :Site ; sh:sparql [ sh:select 'SELECT $this WHERE { $this <http://s/length> 5.0 }' ] .", {"PROPERTY_NOT_ALLOWED_FOR_CLASS"}),
]


@pytest.mark.parametrize(("shapes", "codes"), SHAPE_CASES)
def test_shape_codes(schema, shapes, codes):
    assert {f.code for f in ShapeChecker(schema).check(H + shapes)} == codes
