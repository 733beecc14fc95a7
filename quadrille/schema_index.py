"""Schema index: classes, properties, domains, ranges, hierarchy, enumerations and multiplicities by profile, as relational tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import terms as T
from .dataset import QuadDataset
from .operators.paths import superclasses
from .profiles import CIMS, typed_properties

LITERAL_RANGES = (T.XSD, T.LANG_STRING, T.RDFS + "Literal")


def _is_datatype(c):
    return c.startswith(T.XSD) | (c == T.LANG_STRING) | (c == T.RDFS + "Literal")


@dataclass
class SchemaIndex:
    """Tables over quads (profile, s, p, o): one row of input per triple and profile version IRI."""

    triples: DataFrame

    @staticmethod
    def of(profiles: dict[str, DataFrame]) -> SchemaIndex:
        """From graphs (s, p, o) by version IRI."""
        out = None
        for name, g in profiles.items():
            one = g.select(F.lit(name).alias("profile"), "s", "p", "o")
            out = one if out is None else out.union(one)
        if out is None:
            raise ValueError("no profile graph")
        return SchemaIndex(out)

    def _pairs(self, p: str, a: str, b: str) -> DataFrame:
        return self.triples.filter(F.col("p") == p).select("profile", F.col("s").alias(a), F.col("o.v").alias(b)).distinct()

    @cached_property
    def domains(self) -> DataFrame:
        return self._pairs(T.RDFS + "domain", "property", "class")

    @cached_property
    def ranges(self) -> DataFrame:
        """Declared ranges, and those that the typed-property extraction finds."""
        declared = self._pairs(T.RDFS + "range", "property", "range")
        typed = typed_properties(self.triples.select("s", "p", "o"))
        by_property = self.domains.select("profile", "property").distinct()
        more = by_property.join(typed.select("property", F.coalesce("primitive_type", "reference_type").alias("range")).distinct(), "property").select("profile", "property", "range")
        return declared.union(more).distinct()

    @cached_property
    def subclasses(self) -> DataFrame:
        return self._pairs(T.RDFS + "subClassOf", "class", "super")

    @cached_property
    def classes(self) -> DataFrame:
        """Declared classes, and whatever is used as a domain, a range that is no datatype, or in the hierarchy."""
        declared = self.triples.filter((F.col("p") == T.RDF_TYPE) & F.col("o.v").isin(T.RDFS + "Class", T.OWL + "Class", T.RDFS + "Datatype")).select("profile", F.col("s").alias("class"))
        ranges = self._pairs(T.RDFS + "range", "property", "range").filter(~_is_datatype(F.col("range"))).select("profile", F.col("range").alias("class"))
        sub = self.subclasses
        return declared.union(self.domains.select("profile", "class")).union(ranges).union(sub.select("profile", "class")).union(sub.select("profile", "super")).distinct()

    @cached_property
    def properties(self) -> DataFrame:
        kinds = (T.RDF + "Property", T.OWL + "ObjectProperty", T.OWL + "DatatypeProperty", T.OWL + "AnnotationProperty")
        declared = self.triples.filter((F.col("p") == T.RDF_TYPE) & F.col("o.v").isin(*kinds)).select("profile", F.col("s").alias("property"))
        return declared.union(self.domains.select("profile", "property")).union(self._pairs(T.RDFS + "range", "property", "r").select("profile", "property")).distinct()

    @cached_property
    def enum_members(self) -> DataFrame:
        """Individuals whose type is a declared class of the profile, the class not being part of the vocabulary itself."""
        typed = self.triples.filter(F.col("p") == T.RDF_TYPE).select("profile", F.col("s").alias("member"), F.col("o.v").alias("class"))
        return typed.join(self.classes, ["profile", "class"], "left_semi").select("profile", "class", "member").distinct()

    @cached_property
    def multiplicities(self) -> DataFrame:
        """(profile, property, min, max): from local names such as M:0..n; max null is unbounded."""
        m = self._pairs(CIMS + "multiplicity", "property", "m")
        text = F.regexp_extract("m", r"M:([0-9]+(?:\.\.(?:[0-9]+|n))?)$", 1)
        low, high = F.regexp_extract(text, r"^(\d+)", 1).try_cast("int"), F.regexp_extract(text, r"\.\.(.+)$", 1)
        return m.filter(text != "").select("profile", "property", low.alias("min"), F.when(high == "", low).when(high == "n", F.lit(None)).otherwise(high.try_cast("int")).alias("max")).distinct()

    def texts(self, p: str = T.RDFS + "label") -> DataFrame:
        """First non-blank label or comment of each term."""
        rows = self.triples.filter((F.col("p") == p) & (F.trim("o.v") != "")).select("profile", F.col("s").alias("term"), F.col("o.v").alias("text"))
        return rows.groupBy("profile", "term").agg(F.min("text").alias("text"))

    # scopes: None is all profiles
    def scoped(self, table: DataFrame, scope: list[str] | None) -> DataFrame:
        return table if scope is None else table.filter(F.col("profile").isin(scope))

    def domains_of(self, scope: list[str] | None = None) -> DataFrame:
        return self.scoped(self.domains, scope).groupBy("property").agg(F.sort_array(F.collect_set("class")).alias("classes"))

    def ranges_of(self, scope: list[str] | None = None) -> DataFrame:
        return self.scoped(self.ranges, scope).groupBy("property").agg(F.sort_array(F.collect_set("range")).alias("ranges"))

    def multiplicity_of(self, scope: list[str] | None = None) -> DataFrame:
        """Properties on whose multiplicity all profiles in scope agree."""
        m = self.scoped(self.multiplicities, scope).withColumn("mm", F.struct("min", "max"))
        return m.groupBy("property").agg(F.count_distinct("mm").alias("n"), F.first("mm").alias("mm")).filter("n = 1").select("property", "mm.min", "mm.max")

    def superclasses(self, scope: list[str] | None = None) -> DataFrame:
        """(class, super): the transitive hierarchy."""
        return superclasses(self.scoped(self.subclasses, scope).select("class", "super").distinct(), "class", "super").toDF("class", "super")

    def enumeration_ranges(self, scope: list[str] | None = None) -> DataFrame:
        """(property, member) of properties whose every range is an enumeration."""
        members = self.scoped(self.enum_members, scope).select(F.col("class").alias("range"), "member").distinct()
        marked = self.scoped(self.ranges, scope).select("property", "range").distinct().join(members.select("range").distinct().withColumn("e", F.lit(True)), "range", "left")
        every = marked.groupBy("property").agg(F.bool_and(F.coalesce("e", F.lit(False))).alias("ok")).filter("ok").select("property")
        return marked.join(every, "property", "left_semi").join(members, "range").select("property", "member").distinct()


# endpoint introspection over a dataset
def schema_graphs(d: QuadDataset) -> DataFrame:
    """Named graphs with a class or an ontology."""
    return d.quads.filter(F.col("g").isNotNull() & (F.col("p") == T.RDF_TYPE) & F.col("o.v").isin(T.RDFS + "Class", T.OWL + "Ontology")).select("g").distinct()


def sample_terms(d: QuadDataset, limit: int = 400) -> DataFrame:
    """(g, term): the first ``limit`` predicates and types of each graph, in order."""
    q = d.quads.filter("g is not null")
    terms = q.select("g", F.col("p").alias("term")).union(q.filter(F.col("p") == T.RDF_TYPE).select("g", F.col("o.v").alias("term"))).distinct()
    return terms.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("term"))).filter(F.col("n") <= limit).select("g", "term")


def classify_graphs(terms: DataFrame, index: SchemaIndex) -> DataFrame:
    """(g, profile, total, discriminating): for each graph the profile that declares most of its terms.

    Discriminating terms are declared by one profile alone; ties go to the smaller
    version IRI. Graphs without a declared term are left out.
    """
    declared = index.classes.select("profile", F.col("class").alias("term")).union(index.properties.select("profile", F.col("property"))).distinct()
    rare = declared.groupBy("term").agg(F.count(F.lit(1)).alias("k"))
    hits = terms.join(declared, "term").join(rare, "term")
    tally = hits.groupBy("g", "profile").agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("k") == 1, 1).otherwise(0)).alias("discriminating"))
    best = Window.partitionBy("g").orderBy(F.desc("discriminating"), F.desc("total"), "profile")
    return tally.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n")


def load_endpoint(d: QuadDataset, limit: int = 400) -> tuple[SchemaIndex, DataFrame, DataFrame]:
    """(index of the schema graphs, scope (g, profile), unmatched instance graphs): schema graphs are in scope of all profiles."""
    schema = schema_graphs(d)
    triples = d.quads.join(schema, "g", "left_semi")
    onto = triples.filter(F.col("p") == T.OWL + "versionIRI").groupBy("g").agg(F.min("o.v").alias("profile"))
    named = schema.join(onto, "g", "left").withColumn("profile", F.coalesce("profile", "g"))
    index = SchemaIndex(triples.join(named, "g").select("profile", "s", "p", "o"))
    instances = QuadDataset(d.quads.filter("g is not null").join(schema, "g", "left_anti").select("g", "s", "p", "o"))
    matched = classify_graphs(sample_terms(instances, limit), index)
    scope = matched.select("g", "profile").union(schema.crossJoin(named.select("profile").distinct()).select("g", "profile"))
    unmatched = instances.quads.select("g").distinct().join(matched.select("g"), "g", "left_anti")
    return index, scope, unmatched
