"""SPARQL semantics on small graphs, and random queries against SQL."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille import terms as T
from quadrille.dataset import QuadDataset, map_tables
from quadrille.engine import ask, explain, query, update
from quadrille.plans.compiler import Unsupported, plain
from quadrille.plans.parser import SparqlSyntaxError, parse, parse_query
from quadrille.sinks import results
from quadrille.sources.text import turtle

DATA = """@prefix : <http://a/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a :p 1 ; :q "x"@en , "y" ; :next :b . :b :p 2.5 ; :next :c . :c :p "z" ; :next :a ; :when "2020-03-04T05:06:07.5+05:00"^^xsd:dateTime . :d :p 1.0e0 ; :next [ :p 7 ] .
:g1 { :a :in :g1 . :x :in :g1 } :g2 { :b :in :g2 }"""


@pytest.fixture(scope="module")
def data(spark):
    d = turtle(spark, DATA)
    return QuadDataset(d.quads.cache(), {"": "http://a/", "xsd": T.XSD})


def rows(df):
    return sorted((tuple(None if v is None else str(v["v"] if hasattr(v, "asDict") else v).replace("http://a/", ":") for v in r) for r in df.collect()), key=str)


CASES = [
    ("SELECT ?s { ?s :p ?v FILTER(?v = 1) }", [(":a",), (":d",)]),
    ("SELECT ?s { ?s :p ?v FILTER(?v < 3) }", [(":a",), (":b",), (":d",)]),
    ("SELECT ?s { ?s :p ?v FILTER(?v > 'a') }", [(":c",)]),
    ("SELECT ?s { ?s :p ?v FILTER(!(?v > 2)) }", [(":a",), (":d",)]),
    ("SELECT ?s { ?s :p ?v FILTER(sameTerm(?v, 1)) }", [(":a",)]),
    ("SELECT ?s { ?s :p ?v FILTER(?v / 0 > 0 || ?s = :a) }", [(":a",), (":d",)]),
    ("SELECT ?v { :a :q ?v FILTER(LANG(?v) = 'en') }", [("x",)]),
    ("SELECT ?v { :a :q ?v FILTER(LANGMATCHES(LANG(?v), 'EN')) }", [("x",)]),
    ("SELECT (UCASE(?v) AS ?u) { :a :q ?v }", [("X",), ("Y",)]),
    ("SELECT (LANG(CONCAT(?v, '1'@en)) AS ?l) { :a :q ?v }", [("",), ("en",)]),
    ("SELECT (STRLEN(STR(?v)) AS ?l) { :b :p ?v }", [("3",)]),
    ("SELECT (HOURS(?w) AS ?h) (TZ(?w) AS ?z) (STR(TIMEZONE(?w)) AS ?t) (STR(SECONDS(?w)) AS ?s) { ?x :when ?w }", [("5", "+05:00", "PT5H", "7.5")]),
    ("SELECT (SUM(?v) AS ?t) { ?s :p ?v FILTER(isNumeric(?v)) }", [("11.5",)]),
    ("SELECT (SUM(?v) AS ?t) { ?s :p ?v }", [(None,)]),
    ("SELECT (COUNT(?v + 1) AS ?n) { ?s :p ?v }", [("4",)]),
    ("SELECT (MAX(?v) AS ?m) { ?s :q ?v }", [("y",)]),
    ("SELECT (GROUP_CONCAT(?v; SEPARATOR='-') AS ?c) { :a :q ?v }", [("x-y",)]),
    ("SELECT ?x { :a :next+ ?x }", [(":a",), (":b",), (":c",)]),
    ("SELECT ?x { :a :next* ?x }", [(":a",), (":b",), (":c",)]),
    ("SELECT ?x { ?x :next+ :b }", [(":a",), (":b",), (":c",)]),
    ("SELECT ?x { :a :next{2} ?x }", [(":c",)]),
    ("SELECT ?x { :a :next{0,1} ?x }", [(":a",), (":b",)]),
    ("SELECT ?x { :a !(:p|:q) ?x }", [(":b",)]),
    ("SELECT ?x { :b (^:next)|:next ?x }", [(":a",), (":c",)]),
    ("SELECT ?x { ?x :next+ ?x }", [(":a",), (":b",), (":c",)]),
    ("SELECT ?g ?x { GRAPH ?g { ?x :in ?y } }", [(":g1", ":a"), (":g1", ":x"), (":g2", ":b")]),
    ("SELECT ?x { GRAPH :g1 { ?x :in ?g } ?x :p ?v }", [(":a",)]),
    ("SELECT ?x FROM :g1 FROM :g2 { ?x :in ?g }", [(":a",), (":b",), (":x",)]),
    ("SELECT ?x FROM NAMED :g2 { GRAPH ?g { ?x :in ?y } }", [(":b",)]),
    ("SELECT ?g { GRAPH ?g { } }", [(":g1",), (":g2",)]),
    ("SELECT ?s ?n { ?s :p ?v OPTIONAL { ?s :next ?n FILTER(sameTerm(?v, 1)) } FILTER(isIRI(?s) && isNumeric(?v)) }", [(":a", ":b"), (":b", None), (":d", None)]),
    ("SELECT ?s { ?s :p ?v MINUS { ?s :q ?w } FILTER(isIRI(?s)) }", [(":b",), (":c",), (":d",)]),
    ("SELECT ?s { ?s :p ?v FILTER NOT EXISTS { ?x :q ?w } }", []),
    ("SELECT ?s { ?s :p ?v FILTER(EXISTS { ?s :q ?w } || ?v = 2.5) }", [(":a",), (":b",)]),
    ("SELECT ?x ?y { VALUES (?x ?y) { (:a UNDEF) (UNDEF 2.5) } ?x :p ?y }", [(":a", "1"), (":b", "2.5")]),
    ("SELECT ?X ?x { :a :p ?X . :b :p ?x }", [("1", "2.5")]),
    ("SELECT (IF(?v > 1, 'big', ?v) AS ?r) { ?s :p ?v FILTER(isNumeric(?v) && isIRI(?s)) }", [("1",), ("1.0e0",), ("big",)]),
    ("SELECT (BNODE() AS ?b) (isBlank(BNODE('x')) AS ?i) { }", None),
    ("SELECT ?v (STRDT('5', xsd:integer) + 1 AS ?n) (STR(STRLANG('a', 'en')) AS ?l) { :a :p ?v }", [("1", "6", "a")]),
    ("SELECT (REPLACE('abcab', 'B', 'x', 'i') AS ?r) (SUBSTR('hello', 2, 3) AS ?s) (ENCODE_FOR_URI('a b~*é') AS ?e) { }", [("axcax", "ell", "a%20b~%2A%C3%A9")]),
    ("SELECT (ROUND(-2.5) AS ?r) (CEIL(2.1) AS ?c) (FLOOR(-2.1) AS ?f) { }", [("-2.000000000000000000", "3.000000000000000000", "-3.000000000000000000")]),
    ("SELECT DISTINCT ?t { ?s :p ?v BIND(DATATYPE(?v) AS ?t) FILTER(?s = :a || ?s = :c) }", [("http://www.w3.org/2001/XMLSchema#integer",), ("http://www.w3.org/2001/XMLSchema#string",)]),
    ("SELECT ?s { ?s :p ?v } ORDER BY DESC(?v) LIMIT 2", None),
    ("SELECT ?s ?t { ?s :p ?v SERVICE SILENT <http://none/> { ?s :q ?t } FILTER(?s = :a) }", [(":a", None)]),
    ("SELECT ?z { ?s :p 1 LATERAL { BIND(?s AS ?z) } }", [(":a",)]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_select(data, text, want):
    got = rows(query(data, text))
    assert len(got) > 0 if want is None else got == sorted(want, key=str)


def test_forms(data):
    assert ask(data, "ASK { :a :next/:next :c }") and not ask(data, "ASK { :a :p 2 }")
    made = query(data, "CONSTRUCT { ?s :twice [ :of ?v ] . ?v :bad ?s } WHERE { ?s :p ?v FILTER(isNumeric(?v) && isIRI(?s)) }")
    assert made.count() == 6 and made.select("s").distinct().count() == 6
    assert query(data, "CONSTRUCT WHERE { ?s :next ?o }").count() == 4
    described = query(data, "DESCRIBE :d")
    assert described.count() == 3  # with the triple of the blank node
    assert query(data, "DESCRIBE ?s WHERE { ?s :p 2.5 }").count() == 2


def test_updates(data):
    d = update(data, "DELETE { ?s :p ?v } INSERT { GRAPH :moved { ?s :p ?v } } WHERE { ?s :p ?v FILTER(isIRI(?s)) }")
    assert d.graph("http://a/moved").count() == 4 and data.graph("http://a/moved").count() == 0
    assert d.find(p=T.Iri("http://a/p")).count() == 1
    d = update(data, "WITH :g1 DELETE { ?s :in ?g } WHERE { ?s :in ?g . FILTER(?s = :x) }")
    assert d.graph("http://a/g1").count() == 1
    d = update(data, "CLEAR DEFAULT ; CREATE SILENT GRAPH :new ; MOVE :g1 TO :g3 ; COPY :g2 TO DEFAULT")
    assert sorted(r[0] for r in d.graph_names().collect()) == ["http://a/g2", "http://a/g3"]
    assert d.default_graph().count() == 1
    assert update(data, "DROP ALL").quads.isEmpty()
    loaded = update(data, "LOAD <http://x/> INTO GRAPH :l", load=lambda iri: data)
    assert loaded.graph("http://a/l").count() == data.default_graph().count()
    assert update(data, "LOAD SILENT <http://x/>").quads.count() == data.quads.count()
    with pytest.raises(ValueError):
        update(data, "LOAD <http://x/>")


def test_dataset_operations(spark, data, tmp_path):
    assert data.union(data).quads.count() == data.quads.count()
    assert data.union_default().default_graph().count() == data.default_graph().count() + 3
    assert data.with_graph("http://n/", data.default_graph()).graph("http://n/").count() == data.default_graph().count()
    assert data.without_graph("http://a/g1").graph_names().count() == 1
    data.write(str(tmp_path / "q"))
    again = QuadDataset.read(spark, str(tmp_path / "q"))
    assert again.quads.count() == data.quads.count()
    plan = query(again, "SELECT ?s { ?s <http://a/next> ?o }")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(pred" in plan


def test_errors():
    for bad in ("SELECT ?x { ?x a :C }", "SELECT ?x WHERE { ?x ", "SELECT { ?x ?y ?z }", "FOO", "SELECT ?x { ?x ?p 1 BIND(2 AS ?x) }"):
        with pytest.raises(SparqlSyntaxError):
            parse(bad)
    with pytest.raises(SparqlSyntaxError) as e:
        parse_query("SELECT *\nWHERE { ?x ?y }")
    assert e.value.line == 2


def test_service(spark, data):
    with pytest.raises(Unsupported):
        query(data, "SELECT * { SERVICE <http://x/> { ?s :p ?o } }")
    calls = []

    def service(iri, text, names):
        calls.append((iri, names))
        return data.default_graph().filter("p = 'http://a/next'").select(F.struct(F.lit(1).cast("tinyint").alias("k"), F.col("s").alias("v"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang")).alias("s"))

    out = query(data, "SELECT ?s ?v { ?s :p ?v SERVICE <http://x/> { ?s :next ?o } FILTER(isIRI(?s)) }", service=lambda iri, text, names: service(iri, text, names).withColumn("o", F.col("s")))
    assert out.count() == 4 and calls == [("http://x/", ["s", "o"])]


def test_custom_functions(data):
    from quadrille.functions.values import Value

    f = {"http://f/twice": lambda v: Value("dbl", v.col["v"].try_cast("double") * 2)}
    assert query(data, "SELECT (<http://f/twice>(?v) AS ?t) { :b :p ?v }", functions=f).first()[0] == 5.0


def test_results(data):
    df = query(data, "SELECT ?s ?v { ?s :p ?v } ORDER BY ?s")
    text, stats = results.select_json(df, {"s"}, 3)
    out = json.loads(text)
    assert stats.truncated and len(out["results"]["bindings"]) == 3
    assert out["results"]["bindings"][1]["v"] == {"type": "literal", "value": "1", "datatype": T.INTEGER}
    assert not results.select_json(df, {"s"}, 5)[1].truncated
    assert json.loads(results.ask_json(True))["boolean"]
    nt, stats = results.turtle(query(data, "CONSTRUCT WHERE { :a :q ?v }"), prefixes={"": "http://a/"})
    assert ':a :q "x"@en .' in nt and stats.rows == 2
    assert results.markdown(df, 2).count("\n") == 5


def test_explain_and_plans(spark):
    d = map_tables(spark, "/root/testdata/sf0.001")
    text = explain(d, "PREFIX : <http://example.org/tpch#> SELECT ?n { ?l :l_quantity ?n FILTER(?n > 49) }")
    assert text.startswith("(select (?n)") and "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in text
    assert "ReadSchema: struct<l_quantity:double>" in text
    # keys of different tables never meet, so nothing is joined
    assert query(d, "SELECT ?x { ?x :c_name ?n ; ^:nation.region ?y }").count() == 0


COLUMNS = {"p_size": "int", "p_retailprice": "double", "p_brand": "str"}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sampled_from(sorted(COLUMNS)), st.sampled_from(["<", ">", "=", "!=", ">="]), st.integers(1, 50), st.booleans(), st.sampled_from(["COUNT", "MIN", "MAX"]))
def test_random_queries_match_sql(spark, column, op, n, grouped, agg):
    folder = "/root/testdata/sf0.001"
    value = f'"Brand#{n}"' if COLUMNS[column] == "str" else str(n if column == "p_size" else n * 40)
    sql_value = value.replace('"', "'")
    group, by = ("?t", "p_type AS t,") if grouped else ("", "")
    got = query(map_tables(spark, folder), f"PREFIX : <http://example.org/tpch#> SELECT {group} ({agg}(?v) AS ?r) {{ ?x :{column} ?v ; :p_type ?t FILTER(?v {op} {value}) }}" + (" GROUP BY ?t" if grouped else ""))
    spark.read.parquet(f"{folder}/part.parquet").createOrReplaceTempView("part_random")
    want = spark.sql(f"SELECT {by} {agg}({column}) AS r FROM part_random WHERE {column} {op if op != '!=' else '<>'} {sql_value}" + (" GROUP BY 1" if grouped else ""))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_plain(data):
    assert plain(query(data, "SELECT ?v { :b :p ?v }")).first()[0] == "2.5"
