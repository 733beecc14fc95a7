"""Plans that grow with the input, not with pairs of rows, and their results on odd values."""

import math

import pytest
from pyspark.sql import functions as F

from quadrille import terms as T
from quadrille.dataset import QuadDataset, map_tables
from quadrille.engine import query
from quadrille.operators import paths
from quadrille.profiles import type_quads
from quadrille.sinks.modelxml import untyped_subjects

NS = "PREFIX : <http://example.org/tpch#> "
INF, NAN = math.inf, math.nan
LEFT = [(i, i % 3 if i % 7 else None, v) for i, v in enumerate([0.0, -5.0, 5.0, 100.0, -INF, INF, NAN, None, 7.5, 3000.0, 0.0, -INF, INF, 1e308, -1e308])]
RIGHT = [(i, k, v) for i, (k, v) in enumerate([(0, 1.0), (0, 3001.0), (0, -INF), (1, INF), (1, NAN), (1, 5.0), (2, None), (2, -1e308), (None, 9.0), (2, 1e308)])]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    for name, rows, key in (("a", LEFT, "long"), ("b", RIGHT, "long")):
        spark.createDataFrame(rows, f"{name}_key {key}, {name}_k long, {name}_v double").write.parquet(f"{folder}/{name}.parquet")
    return map_tables(spark, folder, {"a": ("a_key", {}), "b": ("b_key", {})})


def over(x, y):
    """Order of doubles as in the engine: NaN is the largest."""
    return not math.isnan(y) and (math.isnan(x) or x > y)


def found(odd, text):
    return sorted(int(r[0].rsplit("/", 1)[1]) for r in query(odd, NS + text).collect())


def want(test):
    return sorted(a for a, k, v in LEFT if k is not None and v is not None and any(bk == k and w is not None and test(v, w) for _, bk, w in RIGHT))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_not_exists_optional_is_one_row_a_key(odd):
    text = "SELECT ?a ?none WHERE { ?a :a_v ?v ; :a_k ?k BIND(NOT EXISTS { ?x :b_k ?k OPTIONAL { ?b :b_k ?k ; :b_v ?w FILTER(?w > ?v) } FILTER(BOUND(?b)) } AS ?none) }"
    df = query(odd, NS + text)
    assert "max(" in plan(df) and "monotonically_increasing_id" not in plan(df)
    got = sorted((int(r["a"].rsplit("/", 1)[1]), r["none"]) for r in df.collect())
    yes = want(lambda v, w: over(w, v))
    assert got == sorted((a, a not in yes) for a, k, v in LEFT if k is not None and v is not None)


def test_exists_keeps_what_an_optional_leaves_unbound(odd):
    # without BOUND the OPTIONAL decides nothing
    text = "SELECT ?a WHERE { ?a :a_v ?v ; :a_k ?k FILTER EXISTS { ?x :b_k ?k OPTIONAL { ?b :b_k ?k ; :b_v ?w FILTER(?w > ?v) } } }"
    assert found(odd, text) == sorted(a for a, k, v in LEFT if k is not None and v is not None)


def test_exists_union_is_one_row_a_key_in_each_branch(odd):
    branches = "{ ?x :b_k ?k ; :b_v ?w FILTER(?w < ?v) } UNION { ?y :b_key ?n ; :b_v ?u FILTER(?u >= ?v * 2) }"
    head = "SELECT ?a WHERE { ?a :a_key ?n ; :a_v ?v ; :a_k ?k FILTER "
    near = {k: w for k, _, w in RIGHT}
    both = want(lambda v, w: over(v, w))
    both = sorted({*both, *(a for a, k, v in LEFT if k is not None and v is not None and near.get(a) is not None and not over(v * 2, near[a]))})
    df = query(odd, NS + head + f"EXISTS {{ {branches} }} }}")
    assert "min(" in plan(df) and "max(" in plan(df)
    assert found(odd, head + f"EXISTS {{ {branches} }} }}") == both
    assert found(odd, head + f"NOT EXISTS {{ {branches} }} }}") == sorted(a for a, k, v in LEFT if k is not None and v is not None and a not in both)


@pytest.mark.parametrize("op", ["<", ">", "<=", ">="])
@pytest.mark.parametrize("form, value", [("?w - ?v", lambda v, w: w - v), ("?v - ?w", lambda v, w: v - w), ("1 + ?w + ?v", lambda v, w: 1 + w + v)])
@pytest.mark.parametrize("bound", ["3000", "(1.0e0/0)"])
def test_exists_bind_is_one_row_a_key(odd, op, form, value, bound):
    limit = 3000.0 if bound == "3000" else INF
    tests = {"<": lambda d: over(limit, d), ">": lambda d: over(d, limit), "<=": lambda d: not over(d, limit), ">=": lambda d: not over(limit, d)}
    text = f"SELECT ?a WHERE {{ ?a :a_v ?v ; :a_k ?k FILTER EXISTS {{ ?b :b_k ?k ; :b_v ?w BIND({form} AS ?d) FILTER(?d {op} {bound}) }} }}"
    assert ("max(" if (op[0] == ">") == (form != "?v - ?w") else "min(") in plan(query(odd, NS + text))
    assert found(odd, text) == want(lambda v, w: tests[op](value(v, w)))


def test_exists_with_two_bounds_meets_all_rows(odd):
    text = "SELECT ?a WHERE { ?a :a_v ?v ; :a_k ?k FILTER EXISTS { ?b :b_k ?k ; :b_v ?w FILTER(?w > ?v && ?w < ?v + 3000) } }"
    assert found(odd, text) == want(lambda v, w: over(w, v) and over(v + 3000, w))


@pytest.mark.parametrize("first, second", [("?x < ?y", "?y < ?x + 200"), ("?y >= ?x - 3", "?x + 3000 >= ?y"), ("?x < ?y", "?y < 3")])
def test_band_join_pairs_ranges(odd, first, second):
    df = query(odd, NS + f"SELECT ?a ?b WHERE {{ ?a :a_v ?x . ?b :b_v ?y FILTER({first} && {second}) }}")
    assert ("Join Cross" in plan(df)) == (second == "?y < 3")
    tests = {"?y < ?x + 200": lambda x, y: over(y, x) and over(x + 200, y), "?x + 3000 >= ?y": lambda x, y: not over(x - 3, y) and not over(y, x + 3000), "?y < 3": lambda x, y: over(y, x) and over(3, y)}
    got = sorted(tuple(int(v.rsplit("/", 1)[1]) for v in r) for r in df.collect())
    assert got == [(a, b) for a, _, v in LEFT for b, _, w in RIGHT if v is not None and w is not None and tests[second](v, w)]


def test_band_join_in_several_tasks(spark):
    d = map_tables(spark, "/root/testdata/sf0.001")
    df = query(d, NS + "SELECT ?a ?b WHERE { ?a :c_acctbal ?x . ?b :c_acctbal ?y FILTER(?x < ?y && ?y < ?x + 200) }")
    values = [r[0] for r in d.tables["customer"].df.select("c_acctbal").collect()]
    assert df.count() == sum(x < y < x + 200 for x in values for y in values)
    assert len({r[0] for r in df.select(F.spark_partition_id()).distinct().collect()}) > 1


@pytest.fixture
def stages(monkeypatch):
    """Types of what fixpoints write, by name of the stage."""
    seen = {}
    real = paths.staged

    def record(df, name="staged"):
        seen.setdefault(name, []).append(df.dtypes)
        return real(df, name)

    monkeypatch.setattr(paths, "staged", record)
    return seen


CHAIN = [(i, i + 1) for i in range(9)]
GRAPHS = [CHAIN, [*CHAIN, (9, 4)], [(0, 0), (0, 1), (1, 2), (2, 0), (3, 3)], [], [(1, 2), (1, 2), (2, 3), (5, None)]]


@pytest.mark.parametrize("pairs", GRAPHS)
def test_closure_of_numbered_nodes(spark, stages, pairs):
    want = {(a, b) for a, b in pairs if b is not None}
    while True:
        more = want | {(a, d) for a, b in want for c, d in want if b == c}
        if more == want:
            break
        want = more
    edges = spark.createDataFrame([(f"n{a}", None if b is None else f"n{b}") for a, b in pairs], "x string, y string")
    assert sorted(map(tuple, paths.closure(edges).collect())) == sorted((f"n{a}", f"n{b}") for a, b in want)
    assert all(kind == "bigint" for d in stages["path"] for _, kind in d)


def test_quads_of_a_table_compare_rows_that_share_a_key(spark, tmp_path):
    rows = [(1, 5, "x"), (1, 5, "y"), (1, 5, "x"), (2, None, "x"), (None, 7, "z"), (None, 7, "z"), (3, 5, None)]
    for name in ("t", "u"):
        spark.createDataFrame(rows, f"{name}_key long, {name}_n long, {name}_s string").write.parquet(f"{tmp_path}/{name}.parquet")
    d = map_tables(spark, str(tmp_path), {"t": ("t_key", {"t_n": "u"}), "u": (None, {})})
    made = d.as_quads().quads
    want = d.quads_frame().dropDuplicates(["s", "p", "o"])
    assert made.columns == want.columns and sorted(map(str, made.collect())) == sorted(map(str, want.collect()))
    assert "LeftAnti" in plan(made)


def test_types_of_the_profile_are_broadcast(spark):
    quads = QuadDataset.of(spark, [(None, T.Iri("urn:a"), T.Iri("urn:p"), T.Literal("1", T.STRING)), (None, T.Iri("urn:a"), T.Iri("urn:q"), T.Literal("2", T.STRING))]).quads
    types = spark.createDataFrame([("urn:p", T.FLOAT)], "property string, primitive_type string")
    out = type_quads(quads, types)
    assert "strategy=broadcast" in plan(out)
    assert sorted((r["p"], r["o"]["dt"]) for r in out.collect()) == [("urn:p", T.FLOAT), ("urn:q", T.STRING)]


def test_untyped_subjects_in_one_pass(spark):
    rows = [("a", T.RDF_TYPE), ("a", "p"), ("b", "p"), ("b", "q"), ("c", T.RDF_TYPE), ("d", None), (None, "p")]
    out = untyped_subjects(spark.createDataFrame(rows, "s string, p string"))
    assert sorted(map(str, (r[0] for r in out.collect()))) == ["None", "b", "d"]
    assert "Join" not in plan(out)


def test_describe_makes_triples_of_chosen_rows_only(spark, odd, monkeypatch):
    everything = odd.quads_frame().select("s", "p", "o").collect()
    monkeypatch.setattr(type(odd), "quads_frame", lambda self: pytest.fail("made all triples"))
    base = "http://example.org/tpch/"

    def want(*subjects):
        return sorted({str(r) for r in everything if r["s"] in {base + s for s in subjects}})

    def got(text):
        return sorted(map(str, query(odd, NS + text).collect()))

    assert got(f"DESCRIBE <{base}a/3> <{base}b/1> <{base}a/03> <{base}a/x> <urn:none>") == want("a/3", "b/1")
    assert got("DESCRIBE ?b WHERE { ?b :b_v ?w FILTER(?w > 3000) }") == want(*(f"b/{b}" for b, _, w in RIGHT if w is not None and over(w, 3000)))
    assert got(f"DESCRIBE <{base}a/3> ?b WHERE {{ ?b :b_v 5.0e0 }}") == want("a/3", "b/5")
