"""A push parser of RDF/XML with the grid-model extensions, and its Spark scan.

Typed nodes, property attributes, nested nodes, rdf:li, xml:base and xml:lang,
reification, and the parse types Resource, Literal, Collection and Statements.
``md:FullModel`` and ``dm:DifferenceModel`` headers and the three difference
containers become graphs of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from .. import terms as T
from ..dataset import QuadDataset
from .ids import resolve, uuid_iri

RDF, XML = T.RDF, "http://www.w3.org/XML/1998/namespace"
FULL_MODEL, DIFFERENCE_MODEL = T.MD + "FullModel", T.DM + "DifferenceModel"
CONTAINERS = {T.DM + n: T.DM + n for n in ("forwardDifferences", "reverseDifferences", "preconditions")}
SYNTAX = {RDF + n for n in ("RDF", "ID", "about", "parseType", "resource", "nodeID", "datatype")}
XML_LITERAL = RDF + "XMLLiteral"


class RdfXmlError(ValueError):
    pass


class _Frame:
    __slots__ = ("kind", "s", "p", "base", "lang", "li", "text", "filled", "datatype", "reify", "last", "graph", "depth", "head")

    def __init__(self, kind, base, lang, **more):
        self.kind, self.base, self.lang, self.li = kind, base, lang, 0
        self.s = self.p = self.datatype = self.reify = self.last = self.graph = self.head = None
        self.text, self.filled, self.depth = [], False, 0
        for k, v in more.items():
            setattr(self, k, v)


class RdfXmlParser:
    """Feed bytes, take rows (g, s, p, (k, v, dt, lang))."""

    def __init__(self, base: str = "", label: str = "b"):
        self.base, self.label = base, label
        self.rows: list[tuple] = []
        self.prefixes: dict[str, str] = {}
        self.warnings: list[str] = []
        self.version: str | None = None
        self.graph: str | None = None
        self.stack: list[_Frame] = []
        self.blank, self.ids = 0, set()
        p = expat.ParserCreate(namespace_separator=" ")
        p.buffer_text = True
        p.namespace_prefixes = False
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self._chars
        p.StartNamespaceDeclHandler = self._namespace
        p.ProcessingInstructionHandler = self._instruction
        self.expat = p

    def feed(self, data: bytes, last: bool = False) -> list[tuple]:
        try:
            self.expat.Parse(data, last)
        except expat.ExpatError as e:
            raise RdfXmlError(str(e)) from e
        out, self.rows = self.rows, []
        return out

    # events
    def _namespace(self, prefix, uri):
        self.prefixes.setdefault(prefix or "", uri or "")

    def _instruction(self, target, data):
        if target == "iec61970-552":
            m = re.search(r"""version\s*=\s*["']([^"']*)""", data)
            self.version = m[1] if m else data
        else:
            self.warnings.append(f"Processing instruction {target} is ignored")

    @property
    def cim(self) -> bool:
        return "cim" in self.prefixes

    def _iri(self, name: str) -> str:
        ns, sep, local = name.rpartition(" ")
        if not sep:
            raise RdfXmlError(f"{name} has no namespace")
        return ns + local

    def _fresh(self) -> str:
        self.blank += 1
        return f"_:{self.label}-{self.blank}"

    def _emit(self, s: str, p: str, o: tuple):
        self.rows.append((self.graph, s, p, o))

    @staticmethod
    def _node(s: str) -> tuple:
        return (T.BNODE_KIND if s.startswith("_:") else T.IRI_KIND, s, None, None)

    def _literal(self, v: str, dt: str | None, lang: str | None) -> tuple:
        if dt:
            return (T.LITERAL_KIND, v, dt, None)
        return (T.LITERAL_KIND, v, T.LANG_STRING if lang else T.STRING, lang.lower() if lang else None)

    def _reference(self, value: str, base: str) -> str:
        if self.cim and value.startswith("#_"):
            made = uuid_iri(value[1:], self.warnings.append)
            if made:
                return made
        return resolve(base, value)

    def _identifier(self, value: str, base: str) -> str:
        if (base, value) in self.ids:
            self.warnings.append(f"rdf:ID {value} is used again")
        self.ids.add((base, value))
        if self.cim:
            made = uuid_iri(value, self.warnings.append)
            if made:
                return made
        return resolve(base, f"#{value}")

    def _start(self, name: str, attrs: dict[str, str]):
        top = self.stack[-1] if self.stack else None
        if top is not None and top.kind == "xml":
            top.depth += 1
            ns, _, local = name.rpartition(" ")
            shown = {k.rpartition(" ")[2]: v for k, v in attrs.items()}
            top.text.append(f"<{local}" + (f" xmlns={quoteattr(ns)}" if ns else "") + "".join(f" {k}={quoteattr(v)}" for k, v in sorted(shown.items())) + ">")
            return
        base = top.base if top else (self.base or ("urn:uuid:" if self.cim else ""))
        lang = top.lang if top else None
        if f"{XML} base" in attrs:
            base = resolve(base, attrs[f"{XML} base"])
        if f"{XML} lang" in attrs:
            lang = attrs[f"{XML} lang"] or None
        attrs = {self._attribute(k): v for k, v in attrs.items() if not k.startswith(XML)}
        if top is None and name == f"{RDF} RDF":
            self.stack.append(_Frame("doc", base, lang))
        elif top is None or top.kind in ("doc", "statements", "collection"):
            self._node_element(self._iri(name), attrs, base, lang, top)
        elif top.kind == "node":
            self._property(self._iri(name), attrs, base, lang, top)
        elif top.kind == "property":
            if top.filled or "".join(top.text).strip():
                raise RdfXmlError(f"Unexpected element {name}")
            top.text.clear()
            s = self._node_element(self._iri(name), attrs, base, lang, top)
            top.filled = True
            self._statement(top, self._node(s))
        else:
            raise RdfXmlError(f"Unexpected element {name} in an empty property")

    def _attribute(self, name: str) -> str:
        ns, sep, local = name.rpartition(" ")
        if sep:
            return ns + local
        # unqualified rdf attributes of old files
        if local in ("ID", "about", "resource", "parseType", "type", "nodeID", "datatype"):
            return RDF + local
        raise RdfXmlError(f"Attribute {name} has no namespace")

    def _node_element(self, iri: str, attrs: dict[str, str], base: str, lang: str | None, parent: _Frame | None) -> str:
        named = [k for k in ("about", "ID", "nodeID") if RDF + k in attrs]
        if len(named) > 1:
            raise RdfXmlError(f"Both rdf:{named[0]} and rdf:{named[1]}")
        head = None
        if parent is not None and parent.kind == "doc" and iri in (FULL_MODEL, DIFFERENCE_MODEL):
            head, self.graph = iri, iri
        if RDF + "about" in attrs:
            s = self._reference(attrs[RDF + "about"], base)
        elif RDF + "ID" in attrs:
            s = self._identifier(attrs[RDF + "ID"], base)
        elif RDF + "nodeID" in attrs:
            s = f"_:{self.label}-n-{attrs[RDF + 'nodeID']}"
        else:
            s = self._fresh()
        if parent is not None and parent.kind == "collection":
            cell = self._fresh()
            if parent.last is None:
                self._statement(parent, self._node(cell))
            else:
                self._emit(parent.last, RDF + "rest", self._node(cell))
            self._emit(cell, RDF + "first", self._node(s))
            parent.last = cell
        if iri != RDF + "Description":
            self._emit(s, T.RDF_TYPE, self._node(iri))
        self._attributes(s, attrs, base, lang)
        self.stack.append(_Frame("node", base, lang, s=s, head=head))
        return s

    def _attributes(self, s: str, attrs: dict[str, str], base: str, lang: str | None) -> None:
        for k, v in attrs.items():
            if k in SYNTAX:
                continue
            if k == T.RDF_TYPE:
                self._emit(s, k, self._node(resolve(base, v)))
            else:
                self._emit(s, k, self._literal(v, None, lang))

    def _statement(self, f: _Frame, o: tuple) -> None:
        self._emit(f.s, f.p, o)
        if f.reify:
            self._emit(f.reify, T.RDF_TYPE, self._node(RDF + "Statement"))
            self._emit(f.reify, RDF + "subject", self._node(f.s))
            self._emit(f.reify, RDF + "predicate", self._node(f.p))
            self._emit(f.reify, RDF + "object", o)

    def _property(self, iri: str, attrs: dict[str, str], base: str, lang: str | None, parent: _Frame) -> None:
        if iri == RDF + "li":
            parent.li += 1
            iri = f"{RDF}_{parent.li}"
        reify = self._identifier(attrs[RDF + "ID"], base) if RDF + "ID" in attrs else None
        f = _Frame("property", base, lang, s=parent.s, p=iri, reify=reify, datatype=attrs.get(RDF + "datatype"))
        if f.datatype:
            f.datatype = resolve(base, f.datatype)
        kind = attrs.get(RDF + "parseType")
        exclusive = [k for k in ("resource", "nodeID", "parseType") if RDF + k in attrs]
        if len(exclusive) > 1 or exclusive and f.datatype:
            raise RdfXmlError(f"rdf:{exclusive[0]} excludes the other attributes of {iri}")
        others = {k: v for k, v in attrs.items() if k not in SYNTAX}
        if kind == "Resource":
            s = self._fresh()
            self._statement(f, self._node(s))
            f.kind, f.s = "node", s
        elif kind == "Collection":
            f.kind = "collection"
        elif kind == "Statements" and self.cim and iri in CONTAINERS:
            # the container's name is a graph; the header goes on where it ends
            f.kind, f.graph, self.graph = "statements", self.graph, CONTAINERS[iri]
            f.filled = True
        elif kind is not None:
            if kind == "Statements":
                self.warnings.append(f"parseType Statements of {iri} is read as a literal")
            f.kind = "xml"
        elif RDF + "resource" in attrs or RDF + "nodeID" in attrs or others:
            if RDF + "resource" in attrs:
                o = self._reference(attrs[RDF + "resource"], base)
            elif RDF + "nodeID" in attrs:
                o = f"_:{self.label}-n-{attrs[RDF + 'nodeID']}"
            else:
                o = self._fresh()
            self._statement(f, self._node(o))
            self._attributes(o, others, base, lang)
            f.kind = "empty"
        self.stack.append(f)

    def _chars(self, text: str):
        if not self.stack:
            return
        top = self.stack[-1]
        if top.kind == "property":
            if top.filled and text.strip():
                raise RdfXmlError("Text after a nested element")
            top.text.append(text)
        elif top.kind == "xml":
            top.text.append(escape(text))
        elif text.strip():
            raise RdfXmlError(f"Unexpected text {text.strip()[:40]!r}")

    def _end(self, name: str):
        top = self.stack[-1]
        if top.kind == "xml" and top.depth:
            top.depth -= 1
            top.text.append(f"</{name.rpartition(' ')[2]}>")
            return
        self.stack.pop()
        if top.kind == "property" and not top.filled:
            v = "".join(top.text)
            self._statement(top, self._literal(v, top.datatype if v else top.datatype, top.lang))
        elif top.kind == "xml":
            self._statement(top, self._literal("".join(top.text), XML_LITERAL, None))
        elif top.kind == "collection":
            if top.last is None:
                self._statement(top, self._node(RDF + "nil"))
            else:
                self._emit(top.last, RDF + "rest", self._node(RDF + "nil"))
        elif top.kind == "statements":
            self.graph = top.graph
        if top.head:
            self.graph = None


def parse_bytes(data: bytes, base: str = "", label: str | None = None) -> tuple[list[tuple], RdfXmlParser]:
    p = RdfXmlParser(base, label or hashlib.md5(data).hexdigest()[:8])
    return p.feed(data, True), p


def from_bytes(spark: SparkSession, data: bytes, base: str = "") -> QuadDataset:
    """A document in memory (a stream or reader is read first)."""
    rows, p = parse_bytes(data, base)
    return QuadDataset(spark.createDataFrame(rows, T.QUAD_TYPE), p.prefixes)


SCAN_TYPE = f"src string, {T.QUAD_TYPE}"


def scan(spark: SparkSession, paths: Iterable[str], base: str = "", strict: bool = True) -> DataFrame:
    """(src, g, s, p, o) of the files, read in parallel, one task a file or so, in chunks of 1 MB.

    Blank nodes are named by file. With ``strict`` off, a broken file gives the
    quads before the error.
    """
    listed = list(dict.fromkeys(paths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                parser = RdfXmlParser(base, hashlib.md5(path.encode()).hexdigest()[:8])
                fs, at = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                try:
                    with fs.open_input_stream(at) as stream:
                        while data := stream.read(1 << 20):
                            yield quad_batch(parser.feed(data), path)
                    yield quad_batch(parser.feed(b"", True), path)
                except RdfXmlError:
                    if strict:
                        raise
                    yield quad_batch(parser.rows, path)

    files = spark.createDataFrame([(p,) for p in listed], "path string").repartition(max(1, min(len(listed), 10_000)))
    return files.mapInArrow(run, SCAN_TYPE)


OBJECT = pa.struct([("k", pa.int8()), ("v", pa.string()), ("dt", pa.string()), ("lang", pa.string())])


def quad_batch(rows: list[tuple], src: str | None = None) -> pa.RecordBatch:
    """(g, s, p, (k, v, dt, lang)) rows with explicit types, whatever is null or empty."""
    columns = {n: pa.array([r[i] for r in rows], pa.string()) for i, n in enumerate("gsp")}
    columns["o"] = pa.array([dict(zip(("k", "v", "dt", "lang"), r[3])) for r in rows], OBJECT)
    if src is not None:
        columns = {"src": pa.array([src] * len(rows), pa.string())} | columns
    return pa.RecordBatch.from_pydict(columns)


def read_models(spark: SparkSession, paths: Iterable[str], base: str = "", strict: bool = True) -> QuadDataset:
    """All files as one dataset; graphs of one name are merged by set union."""
    df = scan(spark, paths, base, strict)
    return QuadDataset(df.select("g", "s", "p", "o").dropDuplicates(["g", "s", "p", "o"]))
