"""Queries over readers, writers, models, the schema index and static checks, made from the driver's tables, and their SQL.

What is checked against a schema takes it from the tables' own columns: a class a
table, a property a column; SQL finds the same in ``information_schema``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms as T
from .catalog import C, HEAD, N, R, _mapped, _small, flat
from .checks.model import Schema, frame
from .checks.queries import QueryChecker, dependencies, infer_scope
from .checks.shapes import ShapeChecker
from .dataset import QuadDataset, map_tables
from .engine import query, update
from .operators.graphs import Delta, Model, same_graph
from .profiles import duplicate_definitions, unknown_properties
from .schema_index import SchemaIndex, sample_terms, schema_graphs
from .session import fresh_folder, staged
from .sinks import modelxml, results
from .sources.files import Store
from .sources.rdfxml import from_bytes, read_models
from .sources.text import read_ntriples, turtle, write_ntriples

NS = "http://example.org/tpch#"
PREFIXES = {"t": NS}
_T = f"'{NS}'"
_TYPE = "'http://www.w3.org/1999/02/22-rdf-syntax-ns#type'"


def _nations(spark: SparkSession, sf_dir: str) -> QuadDataset:
    """Types, names and regions of the nations."""
    d = _mapped(spark, sf_dir, "nation", "region")
    return QuadDataset(d.quads.filter(F.col("p").isin(T.RDF_TYPE, NS + "n_name", NS + "nation.region") & F.col("s").contains("/nation/")))


_NATIONS = f"""SELECT {N} || n_nationkey AS s, {_TYPE} AS p, 1 AS k, {_T} || 'Nation' AS v FROM nation UNION ALL SELECT {N} || n_nationkey, {_T} || 'n_name', 3, n_name FROM nation
    UNION ALL SELECT {N} || n_nationkey, {_T} || 'nation.region', 1, {R} || n_regionkey FROM nation"""


def model_write_read(spark, sf_dir):
    path = fresh_folder(spark, "model")
    modelxml.write(_nations(spark, sf_dir), path, PREFIXES)
    return flat(read_models(spark, spark.read.text(path).inputFiles()).default_graph())


def model_from_stream(spark, sf_dir):
    text = modelxml.to_string(_nations(spark, sf_dir), PREFIXES)
    return flat(from_bytes(spark, text.encode()).default_graph())


def _difference(spark, sf_dir) -> QuadDataset:
    """Nations above 20 go, those below 5 come, as a difference model."""
    key = F.regexp_extract("s", "([0-9]+)$", 1).cast("int")
    all_ = _nations(spark, sf_dir).quads
    head = QuadDataset.of(spark, [(T.Iri(modelxml.DIFFERENCE_MODEL), T.Iri("urn:uuid:00000000-0000-0000-0000-000000000001"), T.Iri(T.RDF_TYPE), T.Iri(T.DM + "DifferenceModel"))]).quads
    parts = [all_.filter(c).withColumn("g", F.lit(g)) for c, g in ((key < 5, modelxml.FORWARD), (key > 20, modelxml.REVERSE))]
    return QuadDataset(head.unionByName(parts[0]).unionByName(parts[1]))


def difference_write_read(spark, sf_dir):
    path = fresh_folder(spark, "difference")
    modelxml.write(_difference(spark, sf_dir), path, {"cim": NS})  # containers are read as graphs only in documents that declare cim
    m = Model(read_models(spark, spark.read.text(path).inputFiles()))
    return flat(m.forward()).withColumn("part", F.lit("forward")).union(flat(m.reverse()).withColumn("part", F.lit("reverse")))


def difference_containers(spark, sf_dir):
    m = Model(_difference(spark, sf_dir))
    one = spark.range(1)
    return one.select(F.lit(m.is_difference()).alias("difference"), F.lit(m.is_full()).alias("full"), F.lit(m.forward().count()).alias("forward"), F.lit(m.reverse().count()).alias("reverse"), F.lit(m.preconditions().count()).alias("preconditions"))


def ntriples_round_trip(spark, sf_dir):
    path = fresh_folder(spark, "ntriples")
    write_ntriples(_small(spark, sf_dir).quads, path)
    return read_ntriples(spark, path).quads.select(F.coalesce("g", F.lit("")).alias("g"), "p", "s").groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("subjects"))


def turtle_results_read(spark, sf_dir):
    text, _ = results.turtle(_nations(spark, sf_dir).default_graph())
    return flat(turtle(spark, text).default_graph())


def store_union_pattern(spark, sf_dir):
    folder = fresh_folder(spark, "store").removeprefix("file://")
    d = _nations(spark, sf_dir)
    for name, c in (("a", F.col("p") == T.RDF_TYPE), ("b", F.col("p") != T.RDF_TYPE)):
        write_ntriples(QuadDataset(d.quads.filter(c)).default_graph(), f"file://{folder}/{name}.dir")
        lines = [r[0] for r in spark.read.text(f"file://{folder}/{name}.dir").collect()]  # 25 nations
        with open(f"{folder}/{name}.nt", "w") as f:
            f.write("\n".join(lines) + "\n")
    return flat(Store(spark).union(["*.nt"], folder).default_graph())


def load_into_graph(spark, sf_dir):
    folder = fresh_folder(spark, "load").removeprefix("file://")
    import os

    os.makedirs(folder)
    with open(f"{folder}/x.xml", "w") as f:
        f.write(modelxml.to_string(_nations(spark, sf_dir), PREFIXES))
    d = update(QuadDataset.empty(spark), f"LOAD <file://{folder}/x.xml> INTO GRAPH <http://g/loaded>", load=lambda iri: Store(spark).load(iri.removeprefix("file://")))
    return flat(d.graph("http://g/loaded"))


def clear_and_drop(spark, sf_dir):
    d = update(_small(spark, sf_dir), "CREATE GRAPH <http://g/new> ; CLEAR GRAPH <http://g/BUILDING> ; DROP DEFAULT ; DROP SILENT GRAPH <http://g/none>")
    return d.quads.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def results_json(spark, sf_dir):
    text, _ = results.select_json(query(map_tables(spark, sf_dir), HEAD + "SELECT ?n ?x WHERE { ?n :n_name ?x }"), {"n"})
    rows = [(b["n"]["value"], b["n"]["type"], b["x"]["value"]) for b in json.loads(text)["results"]["bindings"]]
    return spark.createDataFrame(rows, "n string, kind string, x string")


def results_row_cap(spark, sf_dir):
    _, stats = results.select_json(query(map_tables(spark, sf_dir), HEAD + "SELECT ?c WHERE { ?c a :Customer }"), {"c"}, max_rows=10)
    return spark.createDataFrame([(stats.rows, stats.truncated)], "n long, truncated boolean")


def results_markdown(spark, sf_dir):
    text = results.markdown(query(map_tables(spark, sf_dir), HEAD + "SELECT ?x WHERE { ?n :n_name ?x }"))
    cells = [x.strip("| ") for x in text.splitlines() if x.startswith("|")][2:]
    return spark.createDataFrame([(x,) for x in cells], "x string")


def untyped_subjects(spark, sf_dir):
    d = _mapped(spark, sf_dir, "customer").default_graph()
    return modelxml.untyped_subjects(d.filter((F.col("p") != T.RDF_TYPE) | (F.regexp_extract("s", "([0-9]+)$", 1).cast("int") % 7 != 0)))


def delta_size(spark, sf_dir):
    base = _nations(spark, sf_dir).default_graph()
    key = F.regexp_extract("s", "([0-9]+)$", 1).cast("int")
    d = Delta.on(base).delete(base.filter(key % 2 == 0)).add(base.filter(key < 4)).add(base.filter(key == 1).withColumn("s", F.lit("http://x/1")))
    return spark.createDataFrame([(d.size(), d.has_changes(), Delta.on(base).has_changes())], "n long, changed boolean, untouched boolean")


def delta_rebase(spark, sf_dir):
    base = _nations(spark, sf_dir).default_graph()
    key = F.regexp_extract("s", "([0-9]+)$", 1).cast("int")
    return flat(Delta.on(base).delete(base.filter(key % 2 == 0)).rebase(base.filter(key < 10)).graph())


def graph_compare(spark, sf_dir):
    base = _nations(spark, sf_dir).default_graph()
    same, other = same_graph(base, base.orderBy(F.desc("o.v"))), same_graph(base, base.filter(~F.col("s").endswith("/3")))
    return spark.createDataFrame([(same, other)], "same boolean, other boolean")


def find_triples(spark, sf_dir):
    return flat(_small(spark, sf_dir).find(p=T.Iri(NS + "region"), o=T.Iri("http://example.org/tpch/region/2")))


def graph_added_and_removed(spark, sf_dir):
    d = _small(spark, sf_dir).with_graph("http://g/extra", _nations(spark, sf_dir).default_graph())
    return d.graph_names().select("g")


def self_equal_variable(spark, sf_dir):
    return query(map_tables(spark, sf_dir), HEAD + "SELECT ?x WHERE { ?x :n_nationkey ?k ; :n_regionkey ?k }")


def fn_constructors(spark, sf_dir):
    return query(map_tables(spark, sf_dir), HEAD + """SELECT ?n (LANG(STRLANG(?nn, "en")) AS ?lang) (STR(DATATYPE(STRDT(?nn, xsd:token))) AS ?dt) (LANGMATCHES(LANG(STRLANG(?nn, "en-US")), "en") AS ?en)
        (ISBLANK(BNODE()) AS ?blank) (STRLEN(STRUUID()) AS ?len) (STRSTARTS(STR(UUID()), "urn:uuid:") AS ?urn) (RAND() < 1.0 AS ?below) (YEAR(NOW()) > 2000 AS ?now) WHERE { ?n :n_name ?nn }""")


def shacl_languages(spark, sf_dir):
    """Names in two languages: a key divisible by 3 has two English ones."""
    from .shacl import validate

    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    lit = lambda v, lang: F.struct(F.lit(T.LITERAL_KIND).cast("tinyint").alias("k"), v.alias("v"), F.lit(T.LANG_STRING).alias("dt"), lang.alias("lang"))
    s = F.concat(F.lit("http://example.org/tpch/nation/"), F.col("n_nationkey").cast("string"))
    two = F.when(F.col("n_nationkey") % 3 == 0, "en").when(F.col("n_nationkey") % 3 == 1, "de").otherwise("fr")
    rows = n.select(s.alias("s"), lit(F.col("n_name"), F.lit("en")).alias("o")).union(n.select(s, lit(F.concat("n_name", F.lit("x")), two)))
    d = QuadDataset(rows.select(F.lit(None).cast("string").alias("g"), "s", F.lit("http://e/label").alias("p"), "o"))
    shape = '@prefix sh: <http://www.w3.org/ns/shacl#> . <http://e/S> sh:targetSubjectsOf <http://e/label> ; sh:property [ sh:path <http://e/label> ; sh:uniqueLang true ; sh:languageIn ( "en" "de" ) ] .'
    return validate(d, shape).select(F.col("focus.v").alias("focus"), F.col("value.v").alias("value"), F.regexp_extract("component", "#(.*)ConstraintComponent$", 1).alias("component"))


# a schema of the tables' columns
_XSD = {"string": "string", "bigint": "integer", "int": "integer", "double": "double"}
CIMS = "http://iec.ch/TC57/1999/rdf-schema-extensions-19990926#"


def schema_graph(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """(s, p, o): a class a table, a property a column; names of uneven length are optional; c_mktsegment ranges over the segments found."""
    rows = []
    iri, text = (lambda v: (T.IRI_KIND, v, None, None)), (lambda v: (T.LITERAL_KIND, v, T.STRING, None))
    for t in tables:
        c = NS + t.capitalize()
        rows += [(c, T.RDF_TYPE, iri(T.RDFS + "Class")), (c, T.RDFS + "label", text(t))]
        for name, kind in spark.read.parquet(f"{sf_dir}/{t}.parquet").dtypes:
            p = NS + name
            range_ = NS + "Segment" if name == "c_mktsegment" else T.XSD + _XSD.get(kind, "string")
            rows += [(p, T.RDF_TYPE, iri(T.RDF + "Property")), (p, T.RDFS + "domain", iri(c)), (p, T.RDFS + "range", iri(range_)), (p, T.RDFS + "label", text(name))]
            rows.append((p, CIMS + "multiplicity", iri(f"{CIMS}M:{'0..1' if len(name) % 2 else '1..1'}")))
    out = spark.createDataFrame(rows, f"s string, p string, o {T.TERM_TYPE}")
    if "customer" in tables:
        members = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit(NS), "c_mktsegment").alias("s")).distinct()
        kind = F.struct(F.lit(T.IRI_KIND).cast("tinyint").alias("k"), F.lit(NS + "Segment").alias("v"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))
        head = spark.createDataFrame([(NS + "Segment", T.RDF_TYPE, iri(T.RDFS + "Class"))], out.schema)
        out = out.union(head).union(members.select("s", F.lit(T.RDF_TYPE).alias("p"), kind.alias("o")))
    return out


def _index(spark, sf_dir, *tables) -> SchemaIndex:
    return SchemaIndex.of({f"http://prof/{t}": staged(schema_graph(spark, sf_dir, t).coalesce(1), "schema") for t in tables})


def _columns(*tables: str) -> str:
    return f"(SELECT table_name AS t, column_name AS c, CASE WHEN column_name = 'c_mktsegment' THEN 'Segment' ELSE data_type END AS k FROM information_schema.columns WHERE table_name IN ({', '.join(map(repr, tables))}))"


_CLASS = f"{_T} || upper(t[1]) || t[2:]"


def index_domains(spark, sf_dir):
    return _index(spark, sf_dir, "customer", "supplier").domains_of().select("property", F.explode("classes").alias("class"))


def index_ranges(spark, sf_dir):
    return _index(spark, sf_dir, "customer", "nation").ranges_of().select("property", F.explode("ranges").alias("range"))


def index_multiplicities(spark, sf_dir):
    return _index(spark, sf_dir, "customer", "part").multiplicity_of(["http://prof/part"])


def index_labels(spark, sf_dir):
    return _index(spark, sf_dir, "customer", "part").texts().select("profile", "term", "text")


def index_enum_members(spark, sf_dir):
    return _index(spark, sf_dir, "customer", "nation").enumeration_ranges()


def index_scoped_properties(spark, sf_dir):
    i = _index(spark, sf_dir, "customer", "nation", "part")
    return i.scoped(i.properties, ["http://prof/nation", "http://prof/part"])


def _with_schema_graphs(spark, sf_dir) -> QuadDataset:
    parts = [schema_graph(spark, sf_dir, t).select(F.lit(f"http://schema/{t}").alias("g"), "s", "p", "o") for t in ("customer", "nation")]
    return QuadDataset(_small(spark, sf_dir).quads.union(parts[0]).union(parts[1]))


def endpoint_schema_graphs(spark, sf_dir):
    return schema_graphs(_with_schema_graphs(spark, sf_dir))


def endpoint_graph_names(spark, sf_dir):
    return _with_schema_graphs(spark, sf_dir).graph_names()


def endpoint_term_sample(spark, sf_dir):
    return sample_terms(_small(spark, sf_dir), 1)


def _found(spark, findings, *codes: str) -> DataFrame:
    return frame(spark, [f for f in findings if f.code in codes]).select("code", "term").distinct()


def _names(spark, sf_dir, table) -> list[str]:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").columns


def _checker(spark, sf_dir, *tables, **options) -> QueryChecker:
    return QueryChecker(Schema.of(_index(spark, sf_dir, *tables)), **options)


def check_unknown_properties(spark, sf_dir):
    pattern = " . ".join(f"?x :{c} ?v{i}" for i, c in enumerate([*_names(spark, sf_dir, "customer"), *_names(spark, sf_dir, "part")]))
    return _found(spark, _checker(spark, sf_dir, "customer").check(HEAD + f"SELECT * WHERE {{ {pattern} }}"), "UNKNOWN_PROPERTY")


def check_unknown_classes(spark, sf_dir):
    values = [r[0] for r in spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_mktsegment").distinct().collect()]
    return _found(spark, _checker(spark, sf_dir, "nation").check(HEAD + "SELECT * WHERE { " + " . ".join(f"?x a :{v}" for v in [*values, "Nation"]) + " }"), "UNKNOWN_CLASS")


def check_enum_as_class(spark, sf_dir):
    values = [r[0] for r in spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_mktsegment").distinct().collect()]
    return _found(spark, _checker(spark, sf_dir, "customer").check(HEAD + "SELECT * WHERE { " + " . ".join(f"?x a :{v}" for v in values) + " }"), "ENUM_USED_AS_CLASS")


def check_domains(spark, sf_dir):
    pattern = " ; ".join(f":{c} ?v{i}" for i, c in enumerate([*_names(spark, sf_dir, "customer"), *_names(spark, sf_dir, "part")]))
    return _found(spark, _checker(spark, sf_dir, "customer", "part").check(HEAD + f"SELECT * WHERE {{ ?x a :Part ; {pattern} }}"), "PROPERTY_NOT_ALLOWED_FOR_CLASS")


def check_implied_types(spark, sf_dir):
    pattern = " . ".join(f"?{t} :{c} ?{c}" for t in ("customer", "part", "nation") for c in _names(spark, sf_dir, t))
    return _found(spark, _checker(spark, sf_dir, "customer", "part", "nation").check(HEAD + f"SELECT * WHERE {{ {pattern} }}"), "QUERY_IMPLIED_TYPE")


def check_datatypes(spark, sf_dir):
    pattern = " ; ".join(f':{c} "text"' for c in _names(spark, sf_dir, "part"))
    return _found(spark, _checker(spark, sf_dir, "part").check(HEAD + f"SELECT * WHERE {{ ?x {pattern} }}"), "DATATYPE_MISMATCH")


def check_enum_values(spark, sf_dir):
    values = sorted({r[0] for t, c in (("customer", "c_mktsegment"), ("orders", "o_orderstatus")) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(c).distinct().collect()})
    return _found(spark, _checker(spark, sf_dir, "customer").check(HEAD + "SELECT * WHERE { " + " . ".join(f"?x :c_mktsegment :{v}" for v in values) + " }"), "INVALID_ENUM_VALUE")


def check_optional_properties(spark, sf_dir):
    pattern = " ; ".join(f":{c} ?{c}" for c in _names(spark, sf_dir, "customer"))
    return _found(spark, _checker(spark, sf_dir, "customer").check(HEAD + f"SELECT * WHERE {{ ?x {pattern} }}"), "PROPERTY_MAY_BE_ABSENT")


def check_graph_configuration(spark, sf_dir):
    values = [r[0] for r in spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_mktsegment").distinct().collect()]
    pattern = " ".join(f"GRAPH <http://g/{v}> {{ ?x :c_name ?y }}" for v in values)
    return _found(spark, _checker(spark, sf_dir, "customer", graphs={"http://g/BUILDING": {"http://prof/customer"}}).check(HEAD + f"SELECT ?x ?y WHERE {{ {pattern} }}"), "GRAPH_NOT_CONFIGURED")


def check_projection(spark, sf_dir):
    names = _names(spark, sf_dir, "customer")
    text = f"SELECT {' '.join('?' + c for c in names)} WHERE {{ ?x {' ; '.join(f':{c} ?{c}' for c in names if len(c) % 2)} }}"
    return frame(spark, [f for f in _checker(spark, sf_dir, "customer").check(HEAD + text) if f.code == "UNBOUND_PROJECTION"]).select("code", F.regexp_replace("term", "^[?]", "").alias("term"))


def check_dynamic_terms(spark, sf_dir):
    names = _names(spark, sf_dir, "nation")
    return _found(spark, _checker(spark, sf_dir, "nation").check(HEAD + "SELECT * WHERE { " + " . ".join(f"?x ?{c} ?y . ?x a ?k{c}" for c in names) + " }"), "DYNAMIC_PREDICATE", "DYNAMIC_CLASS")


def check_shape_properties(spark, sf_dir):
    shape = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix : <http://example.org/tpch#> . :S a sh:NodeShape ; sh:targetClass :Customer ; "
    shape += " , ".join(f"sh:property [ sh:path :{c} ; sh:minCount 1 ]" if not i else f"[ sh:path :{c} ; sh:minCount 1 ]" for i, c in enumerate([*_names(spark, sf_dir, "customer"), *_names(spark, sf_dir, "part")]))
    found = ShapeChecker(Schema.of(_index(spark, sf_dir, "customer"))).check(shape + " .")
    return frame(spark, [f for f in found if f.code == "SHAPE_UNKNOWN_PROPERTY"]).select("term").distinct()


def check_dependencies(spark, sf_dir):
    pattern = " ; ".join(f":{c} ?{c}" for c in _names(spark, sf_dir, "part"))
    found = dependencies(HEAD + f"SELECT * WHERE {{ ?x a :Part ; {pattern} }}", Schema.of(_index(spark, sf_dir, "part", "nation")))
    return spark.createDataFrame([(t,) for t in sorted({x for v in found.values() for x in v if x.startswith(NS)})], "term string")


def check_inferred_scope(spark, sf_dir):
    tables = ("customer", "part", "nation", "region")
    schema = Schema.of(_index(spark, sf_dir, *tables))
    rows = [(t, p) for t in tables for p in sorted(infer_scope(HEAD + "SELECT * WHERE { ?x " + " ; ".join(f":{c} ?{c}" for c in _names(spark, sf_dir, t)) + " }", schema))]
    return spark.createDataFrame(rows, "t string, profile string")


def body_unknown_properties(spark, sf_dir):
    return unknown_properties(_mapped(spark, sf_dir, "nation", "region").quads, _index(spark, sf_dir, "nation").properties)


def body_duplicate_definitions(spark, sf_dir):
    q = _nations(spark, sf_dir).quads
    key = F.regexp_extract("s", "([0-9]+)$", 1).cast("int")
    return duplicate_definitions(q.withColumn("src", F.lit("a")).union(q.filter(key % 3 == 0).withColumn("src", F.lit("b"))))


_PART, _CUST = _columns("part"), _columns("customer")
MODELS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "model_write_read": (model_write_read, _NATIONS),
    "model_from_stream": (model_from_stream, _NATIONS),
    "difference_write_read": (difference_write_read, f"WITH t AS ({_NATIONS}), x AS (SELECT *, regexp_extract(s, '([0-9]+)$', 1)::INT AS n FROM t) SELECT s, p, k, v, 'forward' AS part FROM x WHERE n < 5 UNION ALL SELECT s, p, k, v, 'reverse' FROM x WHERE n > 20"),
    "difference_containers": (difference_containers, "SELECT true AS difference, false AS \"full\", 3 * count(*) FILTER (WHERE n_nationkey < 5) AS forward, 3 * count(*) FILTER (WHERE n_nationkey > 20) AS reverse, 0::BIGINT AS preconditions FROM nation"),
    "ntriples_round_trip": (
        ntriples_round_trip,
        f"""SELECT '' AS g, {_T} || p AS p, n, n AS subjects FROM (SELECT 'n_name' AS p, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM nation UNION ALL SELECT 'r_name', count(DISTINCT n_regionkey) FROM nation
            UNION ALL SELECT 's_name', count(*) FROM supplier UNION ALL SELECT 'nation', count(*) FROM supplier)
            UNION ALL SELECT 'http://g/' || c_mktsegment, {_T} || p, count(*), count(*) FROM customer, (VALUES ('c_name'), ('nation')) v(p) GROUP BY ALL""",
    ),
    "turtle_results_read": (turtle_results_read, _NATIONS),
    "store_union_pattern": (store_union_pattern, _NATIONS),
    "load_into_graph": (load_into_graph, _NATIONS),
    "clear_and_drop": (clear_and_drop, "SELECT 'http://g/' || c_mktsegment AS g, 2 * count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY ALL"),
    "results_json": (results_json, f"SELECT {N} || n_nationkey AS n, 'uri' AS kind, n_name AS x FROM nation"),
    "results_row_cap": (results_row_cap, "SELECT least(count(*), 10) AS n, count(*) > 10 AS truncated FROM customer"),
    "results_markdown": (results_markdown, "SELECT n_name AS x FROM nation"),
    "untyped_subjects": (untyped_subjects, f"SELECT {C} || c_custkey AS s FROM customer WHERE c_custkey % 7 = 0"),
    "delta_size": (delta_size, "SELECT 3 * count(*) FILTER (WHERE n_nationkey % 2 <> 0 OR n_nationkey < 4) + 3 AS n, true AS changed, false AS untouched FROM nation"),
    "delta_rebase": (delta_rebase, f"SELECT * FROM ({_NATIONS}) WHERE regexp_extract(s, '([0-9]+)$', 1)::INT % 2 <> 0 AND regexp_extract(s, '([0-9]+)$', 1)::INT < 10"),
    "graph_compare": (graph_compare, "SELECT count(*) = 25 AS same, count(*) = 24 AS other FROM nation"),
    "find_triples": (find_triples, f"SELECT {N} || n_nationkey AS s, {_T} || 'region' AS p, 1 AS k, {R} || n_regionkey AS v FROM nation WHERE n_regionkey = 2"),
    "graph_added_and_removed": (graph_added_and_removed, "SELECT DISTINCT 'http://g/' || c_mktsegment AS g FROM customer UNION ALL SELECT 'http://g/extra'"),
    "self_equal_variable": (self_equal_variable, f"SELECT {N} || n_nationkey AS x FROM nation WHERE n_nationkey = n_regionkey"),
    "fn_constructors": (fn_constructors, f"SELECT {N} || n_nationkey AS n, 'en' AS lang, '{T.XSD}token' AS dt, true AS en, true AS blank, 36::BIGINT AS len, true AS urn, true AS below, true AS now FROM nation"),
    "shacl_languages": (shacl_languages, f"SELECT {N} || n_nationkey AS focus, NULL::VARCHAR AS value, 'UniqueLang' AS component FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT {N} || n_nationkey, n_name || 'x', 'LanguageIn' FROM nation WHERE n_nationkey % 3 = 2"),
    "index_domains": (index_domains, f"SELECT {_T} || c AS property, {_CLASS} AS class FROM {_columns('customer', 'supplier')}"),
    "index_ranges": (index_ranges, f"SELECT {_T} || c AS property, CASE k WHEN 'Segment' THEN {_T} || k WHEN 'VARCHAR' THEN '{T.XSD}string' WHEN 'DOUBLE' THEN '{T.XSD}double' ELSE '{T.XSD}integer' END AS range FROM {_columns('customer', 'nation')}"),
    "index_multiplicities": (index_multiplicities, f"SELECT {_T} || c AS property, CASE WHEN len(c) % 2 = 1 THEN 0 ELSE 1 END AS min, 1 AS max FROM {_PART}"),
    "index_labels": (index_labels, f"SELECT 'http://prof/' || t AS profile, {_T} || c AS term, c AS text FROM {_columns('customer', 'part')} UNION SELECT 'http://prof/' || t, {_CLASS}, t FROM {_columns('customer', 'part')}"),
    "index_enum_members": (index_enum_members, f"SELECT DISTINCT {_T} || 'c_mktsegment' AS property, {_T} || c_mktsegment AS member FROM customer"),
    "index_scoped_properties": (index_scoped_properties, f"SELECT 'http://prof/' || t AS profile, {_T} || c AS property FROM {_columns('nation', 'part')}"),
    "endpoint_schema_graphs": (endpoint_schema_graphs, "SELECT 'http://schema/' || x AS g FROM (VALUES ('customer'), ('nation')) v(x)"),
    "endpoint_graph_names": (endpoint_graph_names, "SELECT DISTINCT 'http://g/' || c_mktsegment AS g FROM customer UNION SELECT 'http://schema/' || x FROM (VALUES ('customer'), ('nation')) v(x)"),
    "endpoint_term_sample": (endpoint_term_sample, f"SELECT DISTINCT 'http://g/' || c_mktsegment AS g, {_T} || 'c_name' AS term FROM customer"),
    "check_unknown_properties": (check_unknown_properties, f"SELECT 'UNKNOWN_PROPERTY' AS code, {_T} || c AS term FROM {_PART}"),
    "check_unknown_classes": (check_unknown_classes, f"SELECT DISTINCT 'UNKNOWN_CLASS' AS code, {_T} || c_mktsegment AS term FROM customer"),
    "check_enum_as_class": (check_enum_as_class, f"SELECT DISTINCT 'ENUM_USED_AS_CLASS' AS code, {_T} || c_mktsegment AS term FROM customer"),
    "check_domains": (check_domains, f"SELECT 'PROPERTY_NOT_ALLOWED_FOR_CLASS' AS code, {_T} || c AS term FROM {_CUST}"),
    "check_implied_types": (check_implied_types, f"SELECT DISTINCT 'QUERY_IMPLIED_TYPE' AS code, {_CLASS} AS term FROM {_columns('customer', 'part', 'nation')}"),
    "check_datatypes": (check_datatypes, f"SELECT 'DATATYPE_MISMATCH' AS code, {_T} || c AS term FROM {_PART} WHERE k <> 'VARCHAR'"),
    "check_enum_values": (check_enum_values, f"SELECT DISTINCT 'INVALID_ENUM_VALUE' AS code, {_T} || o_orderstatus AS term FROM orders WHERE o_orderstatus NOT IN (SELECT c_mktsegment FROM customer)"),
    "check_optional_properties": (check_optional_properties, f"SELECT 'PROPERTY_MAY_BE_ABSENT' AS code, {_T} || c AS term FROM {_CUST} WHERE len(c) % 2 = 1"),
    "check_graph_configuration": (check_graph_configuration, "SELECT DISTINCT 'GRAPH_NOT_CONFIGURED' AS code, 'http://g/' || c_mktsegment AS term FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    "check_projection": (check_projection, f"SELECT 'UNBOUND_PROJECTION' AS code, c AS term FROM {_CUST} WHERE len(c) % 2 = 0"),
    "check_dynamic_terms": (check_dynamic_terms, f"SELECT 'DYNAMIC_PREDICATE' AS code, '?' || c AS term FROM {_columns('nation')} UNION ALL SELECT 'DYNAMIC_CLASS', '?k' || c FROM {_columns('nation')}"),
    "check_shape_properties": (check_shape_properties, f"SELECT {_T} || c AS term FROM {_PART}"),
    "check_dependencies": (check_dependencies, f"SELECT {_T} || c AS term FROM {_PART} UNION ALL SELECT {_T} || 'Part'"),
    "check_inferred_scope": (check_inferred_scope, "SELECT x AS t, 'http://prof/' || x AS profile FROM (VALUES ('customer'), ('part'), ('nation'), ('region')) v(x)"),
    "body_unknown_properties": (body_unknown_properties, f"SELECT {_T} || c AS p FROM {_columns('region')} UNION ALL SELECT {_T} || 'nation.region'"),
    "body_duplicate_definitions": (body_duplicate_definitions, f"SELECT {N} || n_nationkey AS s, 2::BIGINT AS files FROM nation WHERE n_nationkey % 3 = 0"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in MODELS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in MODELS.items()}
