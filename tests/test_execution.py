"""Timeouts, cancellation, file queries, HTTP sources, the command line and SHACL details."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs

import pytest

from quadrille import terms as T
from quadrille.__main__ import main
from quadrille.dataset import QuadDataset
from quadrille.execution import QueryCancelled, QueryTimeout, guarded, run_files
from quadrille.shacl import summary, validate
from quadrille.sources.files import Store
from quadrille.sources.http import HttpEndpoint, pages
from quadrille.sources.text import turtle


def test_timeout_and_cancel(spark):
    def nap(batches):
        for b in batches:
            time.sleep(10)
            yield b

    slow = lambda: spark.range(2, numPartitions=2).mapInArrow(nap, "id long").collect()
    start = time.time()
    with pytest.raises(QueryTimeout):
        guarded(spark, slow, timeout=0.5)
    cancel = threading.Event()
    threading.Timer(0.3, cancel.set).start()
    with pytest.raises(QueryCancelled):
        guarded(spark, slow, timeout=60, cancel=cancel)
    assert time.time() - start < 30
    assert guarded(spark, lambda: 5) == 5
    with pytest.raises(ZeroDivisionError):
        guarded(spark, lambda: 1 / 0)


def test_run_files(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix : <http://a/> . :x :p 1 , 2 .")
    (tmp_path / "b.ttl").write_text("@prefix : <http://a/> . :y :p 3 .")
    (tmp_path / "bad.ttl").write_text("@prefix : <http://a/> . :x :p ")
    store = Store(spark)
    run = lambda q, *files, **kw: run_files(spark, q, files, str(tmp_path), store, timeout=120, **kw)
    out = run("SELECT ?s ?o { ?s <http://a/p> ?o }", "{a,b}.ttl", max_rows=2)
    assert out.kind == "select" and out.stats.truncated and out.stats.rows == 2
    assert json.loads(out.text)["results"]["bindings"][0]["s"]["type"] == "uri"
    assert json.loads(run("ASK { ?s ?p 3 }", "a.ttl").text) == {"head": {}, "boolean": False}
    assert "<http://a/q>" in run("CONSTRUCT { ?s <http://a/q> ?o } { ?s ?p ?o }", "b.ttl").text or ":q" in run("CONSTRUCT { ?s <http://a/q> ?o } { ?s ?p ?o }", "b.ttl").text
    assert run("SELECT * { ?s ?p ?o }", "none.ttl").error[0] == "FILE_NOT_FOUND"
    assert run("SELECT * { ?s ?p ", "a.ttl").error[0] == "SYNTAX"
    assert run("CLEAR ALL", "a.ttl").error[0] == "READ_ONLY"
    assert run("SELECT * { ?s ?p ?o }", "bad.ttl").error[0] == "PARSE"


@pytest.fixture
def endpoint():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            raw = self.rfile.read(int(self.headers["Content-Length"])).decode()
            form = parse_qs(raw)
            seen.append((self.path, form, self.headers.get("Authorization")))
            if self.path == "/missing":
                self.send_response(404)
                self.end_headers()
                return
            self.send_response(200)
            self.end_headers()
            if self.path == "/shacl":
                self.wfile.write(b"[] a <http://www.w3.org/ns/shacl#ValidationReport> .")
                return
            q = form.get("query", [""])[0]
            if q.startswith("ASK"):
                body = {"head": {}, "boolean": True}
            else:
                n = 2 if "OFFSET 4" not in q else 1
                body = {"head": {"vars": ["s", "g"]}, "results": {"bindings": [{"s": {"type": "uri", "value": f"http://a/{i}"}, "g": {"type": "literal", "value": "x", "xml:lang": "en"}} for i in range(n)]}}
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_http(spark, endpoint):
    url, seen = endpoint
    e = HttpEndpoint(url + "/ds", user="u", password="p")
    assert [r.s.v for r in e.frame(spark, "SELECT * {}").collect()] == ["http://a/0", "http://a/1"]
    assert seen[-1][2] == "Basic dTpw"
    e.update("CLEAR ALL", url + "/update")
    assert seen[-1][1]["update"] == ["CLEAR ALL"]
    assert len(list(pages(e, "SELECT * {}", 2))) == 5
    assert e.graphs() == ["x", "x"]
    missing = HttpEndpoint(url + "/missing")
    assert missing.probe() == url + "/missing/query"
    assert "ValidationReport" in e.shacl("[] a <http://x> .", url + "/shacl")
    from quadrille.engine import query

    d = turtle(spark, "<http://a/1> <http://a/p> 5 .")
    out = query(d, f"SELECT ?s ?v {{ ?s <http://a/p> ?v SERVICE <{url}/q> {{ ?s ?x ?g }} }}", service=lambda iri, text, names: e.frame(spark, "SELECT *", ["s", "x", "g"]))
    assert out.count() == 1


def test_command_line(tmp_path, capsys, monkeypatch, spark):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "schemas").mkdir()
    (tmp_path / "schemas" / "s.ttl").write_text("@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . <http://s/C> a rdfs:Class .")
    (tmp_path / "schemas" / "bad.ttl").write_text("nonsense")
    (tmp_path / "ok.rq").write_text("SELECT ?x { ?x a <http://s/C> }")
    (tmp_path / "no.rq").write_text("SELECT ?x { ?x a <http://s/D> }")
    (tmp_path / "shape.ttl").write_text("@prefix sh: <http://www.w3.org/ns/shacl#> . <http://x/S> sh:targetClass <http://s/D> .")
    assert main(["init"]) == 0 and main(["init"]) == 2
    assert main(["validate", "ok.rq"]) == 0
    assert main(["validate", "*.rq", "shape.ttl", "--format", "json"]) == 1
    assert "UNKNOWN_CLASS" in capsys.readouterr().out
    assert main(["explain", "ok.rq"]) == 0 and "(select (?x)" in capsys.readouterr().out
    assert main(["validate", "gone.rq"]) == 2


SHAPES = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix : <http://a/> . "
DATA = """@prefix : <http://a/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:Sub rdfs:subClassOf :C . :a a :C ; :n "x"@en , "y"@en , "z"@de ; :v 5 ; :w 7 . :b a :Sub ; :v "bad"^^xsd:integer ; :k :a . :c a :C ; :v 1 , 2 ; :w 1 ; :k [ :v 9 ] ."""
SHACL_CASES = [
    (":S sh:targetClass :C ; sh:property [ sh:path :v ; sh:datatype xsd:integer ] .", {("b", "Datatype")}),
    (":S sh:targetClass :C ; sh:property [ sh:path :n ; sh:uniqueLang true ] .", {("a", "UniqueLang")}),
    (":S sh:targetClass :C ; sh:property [ sh:path :n ; sh:languageIn ( 'en' ) ] .", {("a", "LanguageIn")}),
    (":S sh:targetNode :a , :b ; sh:property [ sh:path :n ; sh:minCount 1 ] .", {("b", "MinCount")}),
    (":S sh:targetObjectsOf :k ; sh:nodeKind sh:BlankNode .", {("a", "NodeKind")}),
    (":S sh:targetSubjectsOf :k ; sh:property [ sh:path ( :k :v ) ; sh:maxInclusive 8 ] .", {("c", "MaxInclusive")}),
    (":S sh:targetClass :C ; sh:property [ sh:path :v ; sh:lessThanOrEquals :w ] .", {("c", "LessThanOrEquals")}),
    (":S sh:targetClass :C ; sh:property [ sh:path :v ; sh:equals :w ] .", {("a", "Equals"), ("b", "Equals"), ("c", "Equals")}),
    (":S sh:targetClass :C ; sh:xone ( [ sh:property [ sh:path :n ; sh:minCount 1 ] ] [ sh:property [ sh:path :k ; sh:minCount 1 ] ] ) .", set()),
    (":S sh:targetClass :C ; sh:and ( [ sh:property [ sh:path :n ; sh:minCount 1 ] ] ) .", {("b", "And"), ("c", "And")}),
    (":S sh:targetClass :C ; sh:property [ sh:path :k ; sh:node [ sh:property [ sh:path :n ; sh:minCount 1 ] ] ] .", {("c", "Node")}),
    (":S sh:targetNode :c ; sh:property [ sh:path [ sh:zeroOrMorePath :k ] ; sh:minCount 3 ] .", {("c", "MinCount")}),
    (":S sh:targetClass :C ; sh:deactivated true ; sh:property [ sh:path :v ; sh:maxCount 0 ] .", set()),
    (":S sh:target [ a sh:SPARQLTarget ; sh:select 'SELECT ?this { ?this <http://a/w> 7 }' ] ; sh:property [ sh:path :v ; sh:minExclusive 5 ] .", {("a", "MinExclusive")}),
    (":Cc a sh:ConstraintComponent ; sh:parameter [ sh:path :most ] ; sh:validator [ a sh:SPARQLAskValidator ; sh:ask 'ASK { FILTER($value <= $most) }' ] . :S sh:targetNode :a , :c ; sh:property [ sh:path :w ; :most 3 ] .", {("a", "SPARQL")}),
    (":S sh:targetClass :C ; sh:property [ sh:path :v ; sh:sparql [ sh:message 'm' ; sh:select 'SELECT $this ?value { $this $PATH ?value FILTER(?value = 2) }' ] ] .", {("c", "SPARQL")}),
]


@pytest.mark.parametrize(("shape", "want"), SHACL_CASES)
def test_shacl(spark, shape, want):
    d = turtle(spark, DATA)
    out = validate(d, SHAPES + shape).collect()
    assert {(r.focus.v.rpartition("/")[2], r.component.rpartition("#")[2].replace("ConstraintComponent", "")) for r in out} == want


def test_shacl_summary(spark):
    d = turtle(spark, DATA)
    shape = ":S sh:targetClass :C ; sh:property [ sh:path :z ; sh:minCount 1 ; sh:severity sh:Warning ; sh:message 'needs z' ] , [ sh:path :v ; sh:maxCount 1 ; sh:severity :Odd ] ."
    report = validate(d, SHAPES + shape)
    assert tuple(summary(report).first()) == (False, 1, 3, 0)
    assert {r.message for r in report.filter(f"severity = '{T.SH}Warning'").collect()} == {"needs z"}
    assert summary(validate(QuadDataset.empty(spark), SHAPES + shape)).first()["conforms"]
