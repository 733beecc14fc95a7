"""SPARQL endpoints over HTTP: queries, updates, and schema introspection."""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .. import terms as T
from ..dataset import QuadDataset


class HttpEndpoint:
    """One endpoint. ``timeout`` in seconds; Basic credentials are optional."""

    def __init__(self, url: str, timeout: float = 30.0, user: str | None = None, password: str | None = None):
        self.url, self.timeout = url, timeout
        self.auth = "Basic " + base64.b64encode(f"{user}:{password or ''}".encode()).decode() if user else None

    def _call(self, url: str, form: dict[str, str], accept: str) -> tuple[bytes, str]:
        request = urllib.request.Request(url, urllib.parse.urlencode(form).encode(), {"Accept": accept, "Content-Type": "application/x-www-form-urlencoded"})
        if self.auth:
            request.add_header("Authorization", self.auth)
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return reply.read(), reply.headers.get("Content-Type", "")

    def select(self, text: str) -> dict:
        """SPARQL JSON results."""
        return json.loads(self._call(self.url, {"query": text}, "application/sparql-results+json")[0])

    def update(self, text: str, url: str | None = None) -> None:
        self._call(url or self.url, {"update": text}, "*/*")

    def probe(self) -> str:
        """The URL that answers: the given one, or its /query sibling."""
        try:
            self.select("ASK {}")
        except (urllib.error.URLError, ValueError):
            sibling = HttpEndpoint(self.url.rstrip("/") + "/query", self.timeout)
            sibling.auth = self.auth
            sibling.select("ASK {}")
            self.url = sibling.url
        return self.url

    def frame(self, spark: SparkSession, text: str, names: list[str] | None = None) -> DataFrame:
        """Solutions as term structs, one column a variable."""
        found = self.select(text)
        names = names or found["head"]["vars"]
        rows = [tuple(_term(b.get(n)) for n in names) for b in found["results"]["bindings"]]
        return spark.createDataFrame(rows, ", ".join(f"`{n}` {T.TERM_TYPE}" for n in names))

    def service(self, spark: SparkSession):
        """For the compiler's SERVICE."""

        def run(iri: str, pattern: str, names: list[str]) -> DataFrame:
            endpoint = HttpEndpoint(iri, self.timeout)
            endpoint.auth = self.auth
            return endpoint.frame(spark, f"SELECT * WHERE {pattern}", names)

        return run

    def shacl(self, shapes: str, url: str | None = None) -> str:
        """Post Turtle shapes to a SHACL service; the report as Turtle."""
        request = urllib.request.Request(url or self.url, shapes.encode(), {"Accept": "text/turtle", "Content-Type": "text/turtle"})
        if self.auth:
            request.add_header("Authorization", self.auth)
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return reply.read().decode()

    # introspection
    def schema_graphs(self) -> list[str]:
        q = f"SELECT DISTINCT ?g WHERE {{ GRAPH ?g {{ {{ ?x a <{T.RDFS}Class> }} UNION {{ ?x a <{T.OWL}Ontology> }} }} }}"
        return [b["g"]["value"] for b in self.select(q)["results"]["bindings"]]

    def graphs(self) -> list[str]:
        return [b["g"]["value"] for b in self.select("SELECT DISTINCT ?g WHERE { GRAPH ?g { ?s ?p ?o } }")["results"]["bindings"]]

    def graph(self, spark: SparkSession, name: str) -> QuadDataset:
        df = self.frame(spark, f"SELECT ?s ?p ?o WHERE {{ GRAPH <{name}> {{ ?s ?p ?o }} }}", ["s", "p", "o"])
        return QuadDataset(df.selectExpr(f"'{name}' AS g", "s.v AS s", "p.v AS p", "o"))

    def sample_terms(self, name: str, limit: int = 400) -> list[str]:
        q = f"SELECT DISTINCT ?t WHERE {{ GRAPH <{name}> {{ {{ ?s ?t ?o }} UNION {{ ?s a ?t }} }} }} ORDER BY ?t LIMIT {limit}"
        return [b["t"]["value"] for b in self.select(q)["results"]["bindings"]]


def _term(b: dict | None) -> tuple | None:
    if b is None:
        return None
    if b["type"] == "uri":
        return (T.IRI_KIND, b["value"], None, None)
    if b["type"] == "bnode":
        return (T.BNODE_KIND, f"_:{b['value']}", None, None)
    lang = b.get("xml:lang")
    return (T.LITERAL_KIND, b["value"], T.LANG_STRING if lang else b.get("datatype", T.STRING), lang)


def pages(endpoint: HttpEndpoint, text: str, size: int = 10_000) -> Iterator[dict]:
    """Bindings of a query by LIMIT and OFFSET."""
    at = 0
    while True:
        found = endpoint.select(f"{text} LIMIT {size} OFFSET {at}")["results"]["bindings"]
        yield from found
        if len(found) < size:
            return
        at += size
