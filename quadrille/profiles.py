"""Profile registry: typed properties and class facts of RDFS profiles, and typing of instance data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import terms as T
from .dataset import QuadDataset

CIMS = "http://iec.ch/TC57/1999/rdf-schema-extensions-19990926#"
UML = "http://iec.ch/TC57/NonStandard/UML#"
CONCRETE, ENUMERATION = UML + "concrete", UML + "enumeration"

#: Primitive name -> RDF datatype.
PRIMITIVES: dict[str, str] = {
    **{n: T.STRING for n in "String StringFixedLanguage StringIRI IRI UUID Version".split()},
    "LangString": T.LANG_STRING, "URI": T.XSD + "anyURI", "Boolean": T.BOOLEAN, "Decimal": T.DECIMAL, "Float": T.FLOAT, "Double": T.DOUBLE, "Integer": T.INTEGER,
    "Byte": T.XSD + "byte", "Int": T.XSD + "int", "Long": T.XSD + "long",
    **{n: T.XSD + n[0].lower() + n[1:] for n in "NegativeInteger NonNegativeInteger NonPositiveInteger PositiveInteger UnsignedLong UnsignedByte UnsignedShort UnsignedInt DateTime DateTimeStamp Date Time Duration DayTimeDuration YearMonthDuration HexBinary Base64Binary".split()},
    **{n: T.XSD + "g" + n for n in "Day Month MonthDay Year YearMonth".split()},
}


def _values(g: DataFrame, p: str, name: str) -> DataFrame:
    return g.filter(F.col("p") == p).select("s", F.col("o.v").alias(name)).distinct()


def _local(c: Column) -> Column:
    return F.regexp_extract(c, r"([^#/]*)$", 1)


def typed_properties(g: DataFrame, primitives: dict[str, str] | None = None) -> DataFrame:
    """(rdf_type, property, cim_datatype, primitive_type, reference_type) of a profile graph (s, p, o).

    A property has a domain and one of: a range that isn't an unused association,
    a primitive datatype, or a CIM datatype that resolves through its .value
    property. A range that is a known datatype is a literal. Several domains give
    several rows.
    """
    known = {**PRIMITIVES, **(primitives or {})}
    names = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    classes = g.filter((F.col("p") == T.RDF_TYPE) & F.col("o.v").isin(T.RDFS + "Class", T.OWL + "Class")).select(F.col("s").alias("rdf_type")).distinct()
    domain = _values(g, T.RDFS + "domain", "rdf_type").withColumnRenamed("s", "property").join(classes, "rdf_type")
    stereo = _values(g, CIMS + "stereotype", "st")
    primitive = stereo.filter(_local(F.col("st")) == "Primitive").select("s").distinct()
    composite = stereo.filter(_local(F.col("st")) == "CIMDatatype").select("s").distinct()
    datatype = _values(g, CIMS + "dataType", "d").withColumnRenamed("s", "property")
    unused = g.filter((F.col("p") == CIMS + "AssociationUsed") & (F.col("o.v") == "No")).select(F.col("s").alias("property")).distinct()
    ranges = _values(g, T.RDFS + "range", "r").withColumnRenamed("s", "property").join(unused, "property", "left_anti")
    none = F.lit(None).cast("string")
    xsd = lambda c: F.coalesce(F.try_element_at(names, _local(c)), F.lit(T.STRING))
    is_type = F.col("r").startswith(T.XSD) | (F.col("r") == T.LANG_STRING) | (F.col("r") == T.RDFS + "Literal")
    by_range = domain.join(ranges, "property").select("rdf_type", "property", none.alias("cim_datatype"), F.when(is_type, F.when(F.col("r") == T.RDFS + "Literal", T.STRING).otherwise(F.col("r"))).alias("primitive_type"), F.when(~is_type, F.col("r")).alias("reference_type"))
    by_primitive = domain.join(datatype, "property").join(primitive.withColumnRenamed("s", "d"), "d").select("rdf_type", "property", none.alias("cim_datatype"), xsd(F.col("d")).alias("primitive_type"), none.alias("reference_type"))
    value = datatype.filter(F.col("property").endswith(".value")).select(F.regexp_replace("property", r"\.value$", "").alias("c"), F.col("d").alias("pd"))
    by_composite = (
        domain.join(datatype, "property").join(composite.withColumnRenamed("s", "d"), "d").join(value.withColumnRenamed("c", "d"), "d")
        .select("rdf_type", "property", F.col("d").alias("cim_datatype"), xsd(F.col("pd")).alias("primitive_type"), none.alias("reference_type"))
    )
    return by_range.unionByName(by_primitive).unionByName(by_composite).distinct()


def class_facts(g: DataFrame) -> DataFrame:
    """(class_uri, super_class, is_concrete, is_description, is_enum, is_cim_datatype, is_primitive), one row a class (the least superclass)."""
    classes = g.filter((F.col("p") == T.RDF_TYPE) & F.col("o.v").isin(T.RDFS + "Class", T.OWL + "Class")).select(F.col("s").alias("class_uri")).distinct()
    stereo = g.filter(F.col("p") == CIMS + "stereotype").select(F.col("s").alias("class_uri"), _local(F.col("o.v")).alias("st"))
    flag = lambda name: F.coalesce(F.max(F.col("st") == name), F.lit(False))
    flags = stereo.groupBy("class_uri").agg(flag("concrete").alias("is_concrete"), flag("Description").alias("is_description"), flag("enumeration").alias("is_enum"), flag("CIMDatatype").alias("is_cim_datatype"), flag("Primitive").alias("is_primitive"))
    sup = g.filter(F.col("p") == T.RDFS + "subClassOf").groupBy(F.col("s").alias("class_uri")).agg(F.min("o.v").alias("super_class"))
    out = classes.join(flags, "class_uri", "left").join(sup, "class_uri", "left")
    names = ["is_concrete", "is_description", "is_enum", "is_cim_datatype", "is_primitive"]
    return out.select("class_uri", "super_class", *[F.coalesce(n, F.lit(False)).alias(n) for n in names])


@dataclass
class Profile:
    """A profile graph with what identifies it."""

    graph: DataFrame
    version_iris: frozenset[str]
    cim_ns: str
    keyword: str | None = None
    label: str | None = None
    is_header: bool = False
    info: dict[str, str | None] = field(default_factory=dict)


def _texts(g: DataFrame, wanted: Column) -> dict[tuple[str, str], list[str]]:
    found: dict[tuple[str, str], list[str]] = {}
    for r in g.filter(wanted).select("s", "p", F.col("o.v").alias("v")).distinct().orderBy("s", "p", "v").collect():  # a few ontology facts
        found.setdefault((r.s, r.p), []).append(r.v)
    return found


DCAT, DCT = "http://www.w3.org/ns/dcat#", "http://purl.org/dc/terms/"


def read_profile(data: QuadDataset, cim_ns: str | None = None) -> Profile:
    """Metadata by owl:Ontology (versionIRI, keyword, title), else by the fixed texts of a ``<X>Version`` class.

    Raises ValueError where neither is there, or no cim namespace is known.
    """
    g = data.default_graph()
    cim_ns = cim_ns or data.prefixes.get("cim")
    if not cim_ns:
        raise ValueError("no cim namespace")
    onto = [r[0] for r in g.filter((F.col("p") == T.RDF_TYPE) & (F.col("o.v") == T.OWL + "Ontology")).select("s").distinct().orderBy("s").collect()]
    if onto:
        facts = _texts(g, F.col("s").isin(onto))
        first = lambda *ps: next((facts[k][0] for p in ps for o in onto if (k := (o, p)) in facts), None)
        versions = frozenset(v for o in onto for v in facts.get((o, T.OWL + "versionIRI"), []))
        keyword = first(DCAT + "keyword")
        label = first(DCT + "title", T.RDFS + "label") or keyword
        header = keyword in ("DH", "FH") or any("DocumentHeader" in v or "FileHeader" in v for v in [*versions, *onto])
        return Profile(g, versions, cim_ns, keyword, label, header, {"description": first(DCT + "description"), "version": first(T.OWL + "versionInfo"), "issued": first(DCT + "issued")})
    # fixed values, as a literal or through a blank node
    fixed = g.filter(F.col("p") == CIMS + "isFixed").select("s", F.col("o.v").alias("x"), F.col("o.k").alias("k"))
    nested = g.filter(F.col("p").isin(T.RDFS + "Literal", T.RDFS + "label")).select(F.col("s").alias("x"), F.col("o.v").alias("y"))
    rows = fixed.join(nested, "x", "left").select("s", F.when(F.col("k") == T.LITERAL_KIND, F.col("x")).otherwise(F.col("y")).alias("v")).filter("v is not null").orderBy("s", "v").collect()
    by = {}
    for r in rows:
        by.setdefault(r.s.rpartition(".")[2], []).append(r.v)
    versions = frozenset(v for k, vs in by.items() if k.startswith(("entsoeURI", "baseURI")) for v in vs)
    if not versions:
        raise ValueError("neither an ontology nor version texts")
    short = (by.get("shortName") or [None])[0]
    return Profile(g, versions, cim_ns, short, short, False, {"issued": (by.get("date") or [None])[0], "version": None, "description": None})


class Registry:
    """Profiles by version IRI; immutable entries, duplicates are errors."""

    def __init__(self, primitives: dict[str, str] | None = None):
        self.primitives = dict(primitives or {})
        self.profiles: dict[frozenset[str], Profile] = {}
        self.headers: dict[str, Profile] = {}
        self._properties: dict[frozenset[str], DataFrame] = {}

    def register_primitive(self, name: str, datatype: str) -> None:
        self.primitives[name] = datatype
        self._properties.clear()

    def register(self, p: Profile) -> None:
        if p.is_header:
            if p.cim_ns in self.headers:
                raise ValueError(f"a header profile of {p.cim_ns} is registered")
            self.headers[p.cim_ns] = p
            return
        if not p.version_iris:
            raise ValueError("a profile needs a version IRI")
        if p.version_iris in self.profiles:
            raise ValueError(f"{sorted(p.version_iris)} is registered")
        self.profiles[p.version_iris] = p

    def contains(self, iris: set[str]) -> bool:
        return bool(iris) and all(any(i in k for k in self.profiles) for i in iris)

    def matching(self, iris: set[str]) -> set[frozenset[str]]:
        """The single profile, the one of exactly this set, or one for each IRI; empty if any is unknown."""
        exact = frozenset(iris)
        if exact in self.profiles:
            return {exact}
        found = set()
        for i in iris:
            hits = [k for k in self.profiles if i in k]
            if not hits:
                return set()
            found.update(hits)
        return found

    def _typed(self, key: frozenset[str], p: Profile) -> DataFrame:
        if key not in self._properties:
            self._properties[key] = typed_properties(p.graph, self.primitives)
        return self._properties[key]

    def properties(self, iris: set[str]) -> DataFrame:
        """(property, primitive_type, ...) of the matching profiles; of one property the last version IRI in order wins."""
        parts = [self._typed(k, self.profiles[k]).withColumn("_rank", F.lit(i)) for i, k in enumerate(sorted(self.matching(iris), key=sorted))]
        if not parts:
            raise ValueError(f"no profile for {sorted(iris)}")
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        w = Window.partitionBy("property").orderBy(F.desc("_rank"), "rdf_type")
        return out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_rank")

    def header_properties(self, cim_ns: str) -> DataFrame | None:
        p = self.headers.get(cim_ns)
        return typed_properties(p.graph, self.primitives) if p else None

    def classes(self, iris: set[str]) -> DataFrame:
        """Class facts of the matching profiles; of one class the one that isn't a mere description wins."""
        parts = [class_facts(self.profiles[k].graph) for k in sorted(self.matching(iris), key=sorted)]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        w = Window.partitionBy("class_uri").orderBy("is_description", F.desc("is_concrete"), "super_class")
        return out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def type_quads(quads: DataFrame, properties: DataFrame) -> DataFrame:
    """Literals take the datatype of their property's profile: not plain strings, not empty ones; xsd:anyURI makes IRIs.

    The property table is as large as the schema, not the data: it is broadcast, as
    a shuffle by the few predicates would gather all quads in a few tasks.
    """
    types = properties.filter("primitive_type is not null").groupBy(F.col("property").alias("p")).agg(F.min("primitive_type").alias("_dt"))
    o, none = F.col("o"), F.lit(None).cast("string")
    literal = (o["k"] == T.LITERAL_KIND) & (o["v"] != "")
    made = F.struct(
        F.when(literal & (F.col("_dt") == T.XSD + "anyURI"), T.IRI_KIND).otherwise(o["k"]).cast("tinyint").alias("k"),
        o["v"].alias("v"),
        F.when(literal & (F.col("_dt") == T.XSD + "anyURI"), none).when(literal & F.col("_dt").isNotNull() & (F.col("_dt") != T.STRING), F.col("_dt")).otherwise(o["dt"]).alias("dt"),
        F.when(literal & F.col("_dt").isNotNull() & (F.col("_dt") != T.STRING), none).otherwise(o["lang"]).alias("lang"),
    )
    return quads.join(F.broadcast(types), "p", "left").select("g", "s", "p", made.alias("o"))


def unknown_properties(quads: DataFrame, properties: DataFrame) -> DataFrame:
    """Predicates of the body that no profile declares, each once."""
    return quads.filter((F.col("p") != T.RDF_TYPE) & F.col("g").isNull()).select("p").distinct().join(properties.select(F.col("property").alias("p")).distinct(), "p", "left_anti")


def duplicate_definitions(quads: DataFrame) -> DataFrame:
    """Subjects with the same type stated in several files: (s, files). Needs a ``src`` column."""
    return quads.filter(F.col("p") == T.RDF_TYPE).groupBy("s").agg(F.count_distinct("src").alias("files")).filter("files > 1")
