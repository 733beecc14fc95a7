"""Grid-model files: parser, differences, deltas, writer, other syntaxes."""

import pytest
from pyspark.sql import functions as F

from quadrille import terms as T
from quadrille.dataset import QuadDataset
from quadrille.operators.graphs import Delta, Model, ModelError, same_graph
from quadrille.sinks import modelxml
from quadrille.sources import files, rdfxml, text
from quadrille.sources.ids import uuid_column, uuid_iri

NS = "http://grid.example/schema#"
U = [f"0000000{i}-aaaa-bbbb-cccc-dddddddddddd" for i in range(6)]
HEAD = f'<rdf:RDF xmlns:rdf="{T.RDF}" xmlns:md="{T.MD}" xmlns:dm="{T.DM}" xmlns:cim="{NS}">'


def box(i, name, extra=""):
    return f'<cim:Box rdf:ID="_{U[i]}"><cim:Box.name>{name}</cim:Box.name><cim:Box.in rdf:resource="#_{U[5]}"/>{extra}</cim:Box>'


FULL = f"""<?xml version="1.0"?><?iec61970-552 version="2.0"?>{HEAD}
<md:FullModel rdf:about="urn:uuid:{U[4]}"><md:Model.profile>http://p/1</md:Model.profile></md:FullModel>
{box(0, "a")}{box(1, "b")}{box(2, "c")}</rdf:RDF>"""
DIFF = f"""{HEAD}<dm:DifferenceModel rdf:about="urn:uuid:{U[5]}"><md:Model.Supersedes rdf:resource="urn:uuid:{U[4]}"/>
<dm:preconditions rdf:parseType="Statements"><rdf:Description rdf:about="#_{U[0]}"><cim:Box.name>a</cim:Box.name></rdf:Description></dm:preconditions>
<dm:forwardDifferences rdf:parseType="Statements"><rdf:Description rdf:about="#_{U[1]}"><cim:Box.name>B</cim:Box.name></rdf:Description>{box(3, "new")}</dm:forwardDifferences>
<dm:reverseDifferences rdf:parseType="Statements"><rdf:Description rdf:about="#_{U[1]}"><cim:Box.name>b</cim:Box.name></rdf:Description>{box(2, "c")}</dm:reverseDifferences>
<md:Model.profile>http://p/1</md:Model.profile></dm:DifferenceModel></rdf:RDF>"""


def rows(d):
    return {(r.g, r.s, r.p, r.o.v) for r in d.quads.collect()}


def test_full_model_graphs(spark):
    got, parser = rdfxml.parse_bytes(FULL.encode())
    assert parser.version == "2.0"
    assert sum(g == T.MD + "FullModel" for g, *_ in got) == 2
    assert sum(g is None for g, *_ in got) == 9
    assert (None, f"urn:uuid:{U[0]}", NS + "Box.in", (T.IRI_KIND, f"urn:uuid:{U[5]}", None, None)) in got


def test_difference_containers_and_application(spark):
    full, diff = (Model(rdfxml.from_bytes(spark, x.encode())) for x in (FULL, DIFF))
    assert full.is_full() and not full.is_difference() and diff.is_difference()
    assert diff.supersedes() == [f"urn:uuid:{U[4]}"]
    assert diff.profiles() == ["http://p/1"]  # written after the containers, still in the header
    assert diff.forward().count() == 4 and diff.reverse().count() == 4 and diff.preconditions().count() == 1
    after = diff.apply(full).graph()
    assert after.count() == 9
    names = {r.v for r in after.filter(F.col("p") == NS + "Box.name").select("o.v").collect()}
    assert names == {"a", "B", "new"}
    with pytest.raises(ModelError):
        full.apply(full)
    missing = Model(rdfxml.from_bytes(spark, DIFF.replace("<cim:Box.name>a<", "<cim:Box.name>zzz<").encode()))
    with pytest.raises(ModelError, match="zzz"):
        missing.apply(full)
    other = Model(rdfxml.from_bytes(spark, DIFF.replace(f'Supersedes rdf:resource="urn:uuid:{U[4]}"', 'Supersedes rdf:resource="urn:uuid:x"').encode()))
    with pytest.raises(ModelError, match="superseded"):
        other.apply(full)
    assert other.apply(full, strict_supersedes=False).size() == 9
    with pytest.raises(ModelError):
        full.forward()


def test_delta_set_rules(spark):
    g = lambda *xs: QuadDataset.of(spark, [(None, T.Iri(x), T.Iri("p"), T.Literal("v")) for x in xs]).default_graph()
    d = Delta.on(g("a", "b"))
    assert not d.has_changes()
    d = d.add(g("a", "c"))
    assert d.additions.count() == 1 and d.size() == 3
    d = d.delete(g("b", "c", "zz"))
    assert d.additions.count() == 0 and d.deletions.count() == 1 and d.size() == 1
    assert d.add(g("b")).size() == 2
    assert d.rebase(g("b", "x", "y")).size() == 2
    both = Delta(g("a"), g("a"), g("a"))
    assert both.size() == 1


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("_" + U[0], "urn:uuid:" + U[0]),
        ("_" + U[0].replace("-", ""), "urn:uuid:" + U[0]),
        ("_" + U[0].upper(), "urn:uuid:" + U[0]),
        ("_not-a-uuid", None),
    ],
)
def test_uuid_forms(spark, given, wanted):
    warned = []
    assert uuid_iri(given, warned.append) == wanted
    assert bool(warned) == (given != "_" + U[0])
    assert spark.range(1).select(uuid_column(F.lit("#" + given))).first()[0] == wanted


GRAMMAR = [
    ("<rdf:Description rdf:about='http://a/s' xml:lang='EN'><e:p>x</e:p></rdf:Description>", '<http://a/s> <http://e/p> "x"@en .'),
    ("<rdf:Description rdf:about='http://a/s'><e:p rdf:datatype='http://www.w3.org/2001/XMLSchema#int'>1</e:p></rdf:Description>", '<http://a/s> <http://e/p> "1"^^<http://www.w3.org/2001/XMLSchema#int> .'),
    ("<e:C rdf:about='http://a/s' e:p='v'/>", '<http://a/s> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://e/C> .\n<http://a/s> <http://e/p> "v" .'),
    ("<rdf:Description rdf:about='http://a/s'><e:p><e:C rdf:about='http://a/t'/></e:p></rdf:Description>", "<http://a/s> <http://e/p> <http://a/t> .\n<http://a/t> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://e/C> ."),
    ("<rdf:Bag rdf:about='http://a/s'><rdf:li>1</rdf:li><rdf:li>2</rdf:li></rdf:Bag>", '<http://a/s> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://www.w3.org/1999/02/22-rdf-syntax-ns#Bag> .\n<http://a/s> <http://www.w3.org/1999/02/22-rdf-syntax-ns#_1> "1" .\n<http://a/s> <http://www.w3.org/1999/02/22-rdf-syntax-ns#_2> "2" .'),
    ("<rdf:Description rdf:ID='x' xml:base='http://a/doc'><e:p rdf:resource='y'/></rdf:Description>", "<http://a/doc#x> <http://e/p> <http://a/y> ."),
    ("<rdf:Description rdf:about='http://a/s'><e:p rdf:parseType='Literal'><b>x</b></e:p></rdf:Description>", '<http://a/s> <http://e/p> "<b>x</b>"^^<http://www.w3.org/1999/02/22-rdf-syntax-ns#XMLLiteral> .'),
    ("<rdf:Description rdf:about='http://a/s'><e:p rdf:ID='r'>v</e:p></rdf:Description>", None),
]


@pytest.mark.parametrize(("body", "triples"), GRAMMAR)
def test_grammar_against_ntriples(spark, tmp_path, body, triples):
    doc = f'<rdf:RDF xmlns:rdf="{T.RDF}" xmlns:e="http://e/">{body}</rdf:RDF>'
    got = rdfxml.from_bytes(spark, doc.encode(), "http://base/doc")
    if triples is None:
        assert {r.p.rpartition("#")[2] for r in got.quads.collect()} == {"http://e/p", "type", "subject", "predicate", "object"}
        return
    path = tmp_path / "x.nt"
    path.write_text(triples + "\n# comment\n")
    assert rows(got) == rows(text.read_ntriples(spark, str(path)))


def test_blank_nodes_and_collections(spark):
    doc = f'<rdf:RDF xmlns:rdf="{T.RDF}" xmlns:e="http://e/"><rdf:Description rdf:about="http://a/s"><e:l rdf:parseType="Collection"><rdf:Description rdf:about="http://a/1"/><rdf:Description rdf:about="http://a/2"/></e:l><e:r rdf:parseType="Resource"><e:q>1</e:q></e:r><e:n rdf:nodeID="z"/></rdf:Description></rdf:RDF>'
    got, _ = rdfxml.parse_bytes(doc.encode())
    assert sum(p == T.RDF + "first" for _, _, p, _ in got) == 2
    assert any(p == T.RDF + "rest" and o[1] == T.RDF + "nil" for _, _, p, o in got)
    assert len(got) == 8


@pytest.mark.parametrize("bad", ["<rdf:Description rdf:about='a' rdf:ID='b'/>", "<e:C><e:p rdf:resource='x' rdf:parseType='Literal'/></e:C>", "<e:C>text</e:C>", "<e:C><e:p rdf:resource='x'><e:D/></e:p></e:C>"])
def test_malformed(bad):
    with pytest.raises(rdfxml.RdfXmlError):
        rdfxml.parse_bytes(f'<rdf:RDF xmlns:rdf="{T.RDF}" xmlns:e="http://e/">{bad}</rdf:RDF>'.encode())


@pytest.mark.parametrize("doc", [FULL, DIFF])
def test_write_and_read_again(spark, doc):
    d = rdfxml.from_bytes(spark, doc.encode())
    again = rdfxml.from_bytes(spark, modelxml.to_string(d, {"cim": NS}).encode())
    assert rows(d) == rows(again)


def test_scan_files_and_store(spark, tmp_path):
    (tmp_path / "a.xml").write_text(FULL)
    (tmp_path / "b.xml").write_text(FULL.replace(U[0], U[3]))
    (tmp_path / "c.ttl").write_text("@prefix : <http://a/> . :x a :Y ; :p 'v'@en, 5, (:a :b) ; :q [ :r 1.5 ] . _:b :p true . :g { :x :in :g }")
    assert rdfxml.read_models(spark, files.expand("*.xml", str(tmp_path))).default_graph().count() == 12
    store = files.Store(spark, most=2)
    d = store.union(["*.{xml,ttl}", "a.xml"], str(tmp_path))
    assert d.default_graph().count() > 12 + 2
    assert store.load(str(tmp_path / "a.xml")) is not None and len(store.held) == 2
    with pytest.raises(FileNotFoundError):
        store.load(str(tmp_path / "none.xml"))
    t = store.load(str(tmp_path / "c.ttl"))
    assert t.graph("http://a/g").count() == 1
    assert t.find(p=T.Iri("http://a/p")).count() == 4


def test_same_graph(spark):
    d = rdfxml.from_bytes(spark, FULL.encode()).default_graph()
    assert same_graph(d, d.orderBy("s")) and not same_graph(d, d.limit(3))


def test_config(tmp_path):
    p = tmp_path / "c.jsonc"
    p.write_text('{ // x\n "a": ["http://y", /* z */ 1,], }')
    assert files.read_config(str(p)) == {"a": ["http://y", 1]}
    assert files.read_config(str(tmp_path / "no")) == {}


def test_stream_of_differences(spark, tmp_path):
    from quadrille.streaming import differences

    full, diff = (rdfxml.from_bytes(spark, x.encode()) for x in (FULL, DIFF))
    differences.changes_of(diff.quads, 1).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = differences.run(spark, str(tmp_path / "in"), full.default_graph(), str(tmp_path / "out"), 1)
    assert same_graph(out, Model(diff).apply(Model(full)).graph())
