"""N-Triples and N-Quads by Spark's text scan; Turtle and TriG by the SPARQL triple grammar."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T
from ..dataset import QuadDataset
from ..plans.parser import Parser, SparqlSyntaxError
from ..terms import BNode, Iri, Var

LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:[^\s]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(#.*)?$'


def _unescaped(c: Column) -> Column:
    """The escapes of N-Triples strings. Unicode escapes go through JSON, the rest are the same there."""
    plain = F.from_json(F.concat(F.lit('{"a":"'), F.regexp_replace(F.regexp_replace(c, r"\\'", "'"), r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1"), F.lit('"}')), "a string")["a"]
    return F.when(c.contains("\\"), plain).otherwise(c)


def read_ntriples(spark: SparkSession, paths: str | list[str]) -> QuadDataset:
    """Lines that are no statements are skipped. Splittable: any number of tasks read one file."""
    lines = spark.read.text(paths).select("value", F.md5(F.col("_metadata.file_path")).alias("f"))
    part = lambda i: F.regexp_extract("value", LINE, i)
    rows = lines.filter(F.col("value").rlike(LINE)).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"), part(4).alias("g"), F.substring("f", 1, 8).alias("f"))

    def node(c: str) -> Column:
        x = F.col(c)
        return F.when(x.startswith("<"), x.substr(F.lit(2), F.length(x) - 2)).otherwise(F.concat(F.lit("_:"), F.col("f"), F.lit("-"), x.substr(F.lit(3), F.length(x))))

    o = F.col("o")
    literal = o.startswith('"')
    body = _unescaped(F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1))
    lang, dt = F.lower(F.regexp_extract(o, r'"@([A-Za-z0-9-]+)$', 1)), F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1)
    none = F.lit(None).cast("string")
    term = F.struct(
        F.when(literal, T.LITERAL_KIND).when(o.startswith("_:"), T.BNODE_KIND).otherwise(T.IRI_KIND).cast("tinyint").alias("k"),
        F.when(literal, body).otherwise(node("o")).alias("v"),
        F.when(literal, F.when(lang != "", T.LANG_STRING).when(dt != "", dt).otherwise(T.STRING)).alias("dt"),
        F.when(literal & (lang != ""), lang).otherwise(none).alias("lang"),
    )
    g = F.when(F.col("g") != "", node("g"))
    return QuadDataset(rows.select(g.alias("g"), node("s").alias("s"), F.col("p"), term.alias("o")).dropDuplicates(["g", "s", "p", "o"]))


def write_ntriples(df: DataFrame, path: str) -> None:
    """(s, p, o) or (g, s, p, o) as N-Triples or N-Quads, one file a task."""
    df.select(ntriples_line(df)).write.mode("overwrite").text(path)


def ntriples_line(df: DataFrame) -> Column:
    def node(c: Column) -> Column:
        return F.when(c.startswith("_:"), F.regexp_replace(c, r"[^A-Za-z0-9_:.\-]", "-")).otherwise(F.concat(F.lit("<"), c, F.lit(">")))

    v = F.col("o.v")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        v = F.replace(v, F.lit(a), F.lit(b))
    tag = F.when(F.col("o.lang").isNotNull(), F.concat(F.lit("@"), F.col("o.lang"))).when(F.col("o.dt") != T.STRING, F.concat(F.lit("^^<"), F.col("o.dt"), F.lit(">"))).otherwise("")
    o = F.when(F.col("o.k") == T.LITERAL_KIND, F.concat(F.lit('"'), v, F.lit('"'), tag)).otherwise(node(F.col("o.v")))
    g = [F.when(F.col("g").isNotNull(), F.concat(F.lit(" "), node(F.col("g")))).otherwise("")] if "g" in df.columns else []
    return F.concat(node(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), o, *g, F.lit(" .")).alias("value")


class TurtleParser(Parser):
    """Turtle, and TriG's graph blocks."""

    def document(self) -> list[tuple]:
        """(graph or None, s, p, o) terms."""
        out: list[tuple] = []
        while self.tok.kind != "end":
            if self.tok.kind == "lang" and self.tok.text in ("@prefix", "@base"):
                word = self.next().text
                if word == "@prefix":
                    name = self.next().text[:-1]
                    self.prefixes[name] = self.iri_ref()
                else:
                    self.base = self.iri_ref()
                self.need(".")
            elif self.peek("PREFIX", "BASE"):
                self.prologue()
            elif self.peek("{") or self.peek("GRAPH") or self.tokens[self.i + 1].text == "{":
                self.take("GRAPH")
                g = None if self.peek("{") else self.term()
                self.need("{")
                while not self.take("}"):
                    if not self.take("."):
                        out += [(g, t) for t in self.triples(paths=False)]
            else:
                before = self.i
                out += [(None, t) for t in self.triples(paths=False)]
                if self.i == before:
                    self.fail(f"Unexpected {self.tok.text}")
        return [(self._ground(g), self._ground(t.s), self._ground(t.p), self._ground(t.o)) for g, t in out]

    def starts_node(self) -> bool:
        return super().starts_node() and self.tokens[self.i + 1].text != "{"

    def _ground(self, x):
        if isinstance(x, Var):
            if not x.name.startswith("_:"):
                raise SparqlSyntaxError(f"?{x.name} in data")
            return BNode(f"{self.label}-{x.name[2:]}")
        return x

    label = "t"


def parse_turtle(text: str, base: str = "") -> tuple[list[tuple], dict[str, str]]:
    p = TurtleParser(text, base=base)
    p.label = hashlib.md5(text.encode()).hexdigest()[:8]
    return p.document(), p.prefixes


def turtle(spark: SparkSession, text: str, base: str = "") -> QuadDataset:
    rows, prefixes = parse_turtle(text, base)
    rows = list(dict.fromkeys(rows))
    return QuadDataset.of(spark, [(Iri(g.value) if isinstance(g, Iri) else g, s, p, o) for g, s, p, o in rows], prefixes)


def read_turtle(spark: SparkSession, paths: Iterable[str]) -> QuadDataset:
    """Turtle and TriG files, parsed on the executors; a file is one task."""
    import pyarrow.fs

    from .rdfxml import quad_batch

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                with fs.open_input_stream(at) as stream:
                    rows, _ = parse_turtle(stream.read().decode())
                object_ = lambda o: (T.BNODE_KIND, T.node_string(o), None, None) if isinstance(o, BNode) else T.term_tuple(o)
                yield quad_batch([(g and T.node_string(g), T.node_string(s), p.value, object_(o)) for g, s, p, o in rows])

    listed = list(dict.fromkeys(paths))
    files = spark.createDataFrame([(p,) for p in listed], "path string").repartition(max(1, min(len(listed), 10_000)))
    return QuadDataset(files.mapInArrow(run, T.QUAD_TYPE).dropDuplicates(["g", "s", "p", "o"]))
