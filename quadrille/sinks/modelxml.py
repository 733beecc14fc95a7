"""Grid-model RDF/XML from quads. Elements are made on the executors, one string a subject; only the document order is global."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import terms as T
from ..dataset import QuadDataset
from ..operators.graphs import DIFFERENCE_MODEL, FORWARD, FULL_MODEL, PRECONDITIONS, REVERSE

VERSION = "2.0"


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _quoted(c: Column) -> Column:
    return F.replace(_escaped(c), F.lit('"'), F.lit("&quot;"))


def _name(c: Column, prefixes: dict[str, str]) -> Column:
    """Qualified name; without a known prefix the namespace is declared in place by the caller's prefixes only."""
    out = None
    for p, ns in sorted(prefixes.items(), key=lambda x: -len(x[1])):
        hit = F.concat(F.lit(f"{p}:" if p else ""), F.substring(c, F.lit(len(ns) + 1), F.length(c)))
        out = F.when(c.startswith(ns), hit) if out is None else out.when(c.startswith(ns), hit)
    return out


def _reference(c: Column) -> Column:
    return F.when(c.startswith("urn:uuid:"), F.concat(F.lit("#_"), F.substring(c, F.lit(10), F.length(c)))).otherwise(c)


def elements(triples: DataFrame, prefixes: dict[str, str], concrete: list[str] | None = None, top: bool = True) -> DataFrame:
    """(type, s, xml) of the subjects of (s, p, o); compounds (blank nodes met once as objects) are nested one level at a time.

    ``concrete``: classes written with rdf:ID; None: all classes. Literals are
    written without datatype and language.
    """
    types = triples.filter(F.col("p") == T.RDF_TYPE).groupBy("s").agg(F.min("o.v").alias("type"))
    inner = triples.filter((F.col("p") != T.RDF_TYPE) & ~F.col("s").startswith("_:"))
    blank = triples.filter(F.col("s").startswith("_:"))
    body = blank.filter(F.col("p") != T.RDF_TYPE)
    nested = (
        body.withColumn("x", _property(prefixes, F.lit(None).cast("string"))).groupBy("s").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", F.col("o.v").alias("v"), "x"))), lambda e: e["x"]), "").alias("inner"))
        .join(types, "s", "left")
        .select(F.col("s").alias("b"), F.concat(F.lit("<"), F.coalesce(_name(F.col("type"), prefixes), F.lit("rdf:Description")), F.lit(">"), F.col("inner"), F.lit("</"), F.coalesce(_name(F.col("type"), prefixes), F.lit("rdf:Description")), F.lit(">")).alias("nested"))
    )
    props = inner.join(nested, (F.col("o.k") == T.BNODE_KIND) & (F.col("o.v") == F.col("b")), "left").withColumn("x", _property(prefixes, F.col("nested")))
    grouped = props.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("p", F.col("o.v").alias("v"), "x"))).alias("ps"))
    subjects = triples.filter(~F.col("s").startswith("_:")).select("s").distinct()
    all_ = subjects.join(types, "s", "left").join(grouped, "s", "left")
    tag = F.coalesce(_name(F.col("type"), prefixes), F.lit("rdf:Description"))
    own = F.col("type").isNotNull() & F.col("s").startswith("urn:uuid:")
    if concrete is not None:
        own = own & F.col("type").isin(concrete)
    ident = F.when(own, F.concat(F.lit(' rdf:ID="_'), F.substring("s", 10, 1000), F.lit('"'))).otherwise(F.concat(F.lit(' rdf:about="'), _quoted(_reference(F.col("s"))), F.lit('"')))
    inside = F.coalesce(F.array_join(F.transform("ps", lambda e: e["x"]), ""), F.lit(""))
    xml = F.concat(F.lit("<"), tag, ident, F.lit(">"), inside, F.lit("</"), tag, F.lit(">"))
    return all_.select("type", "s", xml.alias("xml"))


def _property(prefixes: dict[str, str], nested: Column) -> Column:
    name = _name(F.col("p"), prefixes)
    o = F.col("o")
    text = F.concat(F.lit("<"), name, F.lit(">"), _escaped(o["v"]), F.lit("</"), name, F.lit(">"))
    ref = F.concat(F.lit("<"), name, F.lit(' rdf:resource="'), _quoted(_reference(o["v"])), F.lit('"/>'))
    box = F.concat(F.lit("<"), name, F.lit(">"), nested, F.lit("</"), name, F.lit(">"))
    return F.when(o["k"] == T.LITERAL_KIND, text).when(nested.isNotNull(), box).otherwise(ref)


def untyped_subjects(triples: DataFrame) -> DataFrame:
    """Subjects without a class: a full model should have none."""
    typed = F.max(F.coalesce(F.col("p") == T.RDF_TYPE, F.lit(False)))
    return triples.groupBy("s").agg(typed.alias("typed")).filter("not typed").select("s")


def document(data: QuadDataset, prefixes: dict[str, str], concrete: list[str] | None = None, version: str = VERSION) -> DataFrame:
    """(part, type, s, value): lines of the document; ordered by the first three they are the file."""
    names = {"rdf": T.RDF, "md": T.MD, "dm": T.DM} | prefixes
    difference = not data.quads.filter(F.col("g") == DIFFERENCE_MODEL).isEmpty()
    spark = data.spark
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<?iec61970-552 version="{version}"?>\n<rdf:RDF ' + " ".join(f"xmlns{':' * bool(k)}{k}={quoteattr(v)}" for k, v in sorted(names.items())) + ' xml:base="urn:uuid:">'
    header = elements(data.graph(DIFFERENCE_MODEL if difference else FULL_MODEL), names, [])
    rows: list[tuple] = [(0, "", "", head)]
    if not difference:
        body = elements(data.default_graph(), names, concrete).select(F.lit(2).alias("part"), F.coalesce("type", F.lit("")).alias("type"), "s", F.col("xml").alias("value"))
        parts = header.select(F.lit(1).alias("part"), F.coalesce("type", F.lit("")), "s", "xml").union(body)
    else:
        # the header stays open around its containers
        parts = header.select(F.lit(1).alias("part"), F.coalesce("type", F.lit("")), "s", F.regexp_replace("xml", "</[^>]*>$", ""))
        for i, (g, name) in enumerate(((PRECONDITIONS, "preconditions"), (FORWARD, "forwardDifferences"), (REVERSE, "reverseDifferences"))):
            rows += [(2 + 3 * i, "", "", f'<dm:{name} rdf:parseType="Statements">'), (4 + 3 * i, "", "", f"</dm:{name}>")]
            found = elements(data.graph(g), names, concrete)
            parts = parts.union(found.select(F.lit(3 + 3 * i).alias("part"), F.coalesce("type", F.lit("")), "s", "xml"))
        rows.append((12, "", "", "</dm:DifferenceModel>"))
    rows.append((99, "", "", "</rdf:RDF>"))
    return parts.union(spark.createDataFrame(rows, "part int, type string, s string, value string")).toDF("part", "type", "s", "value")


def write(data: QuadDataset, path: str, prefixes: dict[str, str], concrete: list[str] | None = None, sort: bool = True) -> None:
    """One text file under ``path``; sorted by part, class and subject."""
    doc = document(data, prefixes, concrete)
    ordered = doc.orderBy("part", "type", "s") if sort else doc.orderBy("part")
    ordered.coalesce(1).select("value").write.mode("overwrite").text(path)


def to_string(data: QuadDataset, prefixes: dict[str, str], concrete: list[str] | None = None) -> str:
    """A small document as text."""
    return "\n".join(r[0] for r in document(data, prefixes, concrete).orderBy("part", "type", "s").select("value").collect())


__all__ = ["document", "elements", "to_string", "untyped_subjects", "write"]
