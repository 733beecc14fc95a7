"""Findings, severities and the driver-side view of a schema."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from .. import terms as T
from ..schema_index import SchemaIndex

ERROR, WARNING, INFO, HINT, OFF = "ERROR", "WARNING", "INFO", "HINT", "OFF"

#: code -> severity before overrides
CODES: dict[str, str] = {
    "SYNTAX_ERROR": ERROR, "UNKNOWN_CLASS": ERROR, "UNKNOWN_PROPERTY": ERROR, "UNKNOWN_VOCABULARY_TERM": WARNING, "ENUM_USED_AS_CLASS": WARNING, "GRAPH_NOT_CONFIGURED": WARNING,
    "DYNAMIC_PREDICATE": INFO, "DYNAMIC_CLASS": INFO, "PROPERTY_NOT_ALLOWED_FOR_CLASS": WARNING, "QUERY_IMPLIED_TYPE": HINT, "DATATYPE_MISMATCH": WARNING, "INVALID_ENUM_VALUE": ERROR,
    "PATH_CHAIN_MISMATCH": WARNING, "PROPERTY_MAY_BE_ABSENT": HINT, "UNKNOWN_TERM_IN_EXPRESSION": WARNING, "UNBOUND_PROJECTION": WARNING, "UNUSED_VARIABLE": HINT,
    "SHAPE_UNKNOWN_CLASS": ERROR, "SHAPE_UNKNOWN_PROPERTY": ERROR, "SHAPE_NODE_KIND_MISMATCH": WARNING, "SHAPE_DATATYPE_MISMATCH": WARNING, "SHAPE_CLASS_MISMATCH": WARNING, "SHAPE_CARDINALITY_CONTRADICTION": ERROR,
    "SHAPE_INVALID_PARAMETER": ERROR, "SHAPE_CARDINALITY_EXCEEDS_SCHEMA": WARNING, "SHAPE_RANGE_CONTRADICTION": ERROR, "SHAPE_INVALID_ENUM_VALUE": ERROR, "SHAPE_UNKNOWN_DATATYPE": WARNING, "SHAPE_UNKNOWN_VOCABULARY_TERM": WARNING,
}
#: Strictness never changes these.
PINNED = frozenset({"SYNTAX_ERROR"})
LEVELS = (OFF, HINT, INFO, WARNING, ERROR)


@dataclass(frozen=True)
class Finding:
    code: str
    message: str
    term: str | None = None
    line: int | None = None
    column: int | None = None
    graph: str | None = None
    profiles: tuple[str, ...] = ()
    elsewhere: tuple[str, ...] = ()
    hint: str | None = None
    severity: str = ""

    def __post_init__(self):
        if not self.severity:
            object.__setattr__(self, "severity", CODES[self.code])


def adjust(findings: list[Finding], overrides: dict[str, str] | None = None, strictness: str = "normal") -> list[Finding]:
    """Overrides by code, then strictness: strict raises warnings to errors, lenient lowers errors to warnings and drops hints."""
    out = []
    for f in findings:
        s = (overrides or {}).get(f.code, f.severity)
        if f.code not in PINNED:
            if strictness == "strict" and s == WARNING:
                s = ERROR
            elif strictness == "lenient":
                s = {ERROR: WARNING, HINT: OFF}.get(s, s)
        if s != OFF:
            out.append(replace(f, severity=s))
    return out


def frame(spark: SparkSession, findings: list[Finding]) -> DataFrame:
    rows = [(f.severity, f.line, f.column, f.message, f.code, f.term, list(f.profiles), list(f.elsewhere), f.graph, f.hint) for f in findings]
    return spark.createDataFrame(rows, "severity string, line int, col int, message string, code string, term string, profiles array<string>, elsewhere array<string>, graph string, hint string")


@dataclass
class Schema:
    """Tables of an index as sets by profile; schemas are small."""

    classes: dict[str, set[str]] = field(default_factory=dict)
    properties: dict[str, set[str]] = field(default_factory=dict)
    domains: dict[str, dict[str, set[str]]] = field(default_factory=dict)
    ranges: dict[str, dict[str, set[str]]] = field(default_factory=dict)
    supers: dict[str, set[str]] = field(default_factory=dict)
    members: dict[str, dict[str, set[str]]] = field(default_factory=dict)
    multiplicities: dict[str, dict[str, tuple[int | None, int | None]]] = field(default_factory=dict)

    @staticmethod
    def of(index: SchemaIndex) -> Schema:
        s = Schema()
        for r in index.classes.collect():
            s.classes.setdefault(r[1], set()).add(r[0])
        for r in index.properties.collect():
            s.properties.setdefault(r[1], set()).add(r[0])
        for r in index.domains.collect():
            s.domains.setdefault(r[1], {}).setdefault(r[2], set()).add(r[0])
        for r in index.ranges.collect():
            s.ranges.setdefault(r[1], {}).setdefault(r[2], set()).add(r[0])
        for r in index.enum_members.collect():
            s.members.setdefault(r[1], {}).setdefault(r[2], set()).add(r[0])
        for r in index.multiplicities.collect():
            s.multiplicities.setdefault(r[1], {})[r[0]] = (r[2], r[3])
        direct: dict[str, set[str]] = {}
        for r in index.subclasses.collect():
            direct.setdefault(r[1], set()).add(r[2])
        for c in direct:
            seen, todo = set(), [c]
            while todo:
                for d in direct.get(todo.pop(), ()):
                    if d not in seen:
                        seen.add(d)
                        todo.append(d)
            s.supers[c] = seen
        return s

    @property
    def profiles(self) -> set[str]:
        return set().union(*self.classes.values(), *self.properties.values()) if self.classes or self.properties else set()

    @staticmethod
    def within(found: set[str] | None, scope: set[str] | None) -> bool:
        return bool(found) and (scope is None or bool(found & scope))

    def is_class(self, c: str, scope: set[str] | None) -> bool:
        return self.within(self.classes.get(c), scope)

    def is_property(self, p: str, scope: set[str] | None) -> bool:
        return self.within(self.properties.get(p), scope)

    def is_member(self, m: str, scope: set[str] | None) -> bool:
        return any(self.within(ms.get(m), scope) for ms in self.members.values())

    def domains_of(self, p: str, scope: set[str] | None) -> set[str]:
        return {c for c, ps in self.domains.get(p, {}).items() if self.within(ps, scope)}

    def ranges_of(self, p: str, scope: set[str] | None) -> set[str]:
        return {c for c, ps in self.ranges.get(p, {}).items() if self.within(ps, scope)}

    def is_a(self, c: str, d: str) -> bool:
        return c == d or d in self.supers.get(c, ())

    def related(self, c: str, d: str) -> bool:
        return self.is_a(c, d) or self.is_a(d, c)

    def multiplicity(self, p: str, scope: set[str] | None) -> tuple[int | None, int | None] | None:
        found = {m for prof, m in self.multiplicities.get(p, {}).items() if scope is None or prof in scope}
        return found.pop() if len(found) == 1 else None

    def enum_members(self, p: str, scope: set[str] | None) -> set[str] | None:
        """Members allowed for a property all of whose ranges are enumerations."""
        ranges = self.ranges_of(p, scope)
        if not ranges or not all(r in self.members for r in ranges):
            return None
        return {m for r in ranges for m, ps in self.members[r].items() if self.within(ps, scope)}


#: Terms of closed vocabularies; what is not here is a typo.
VOCABULARY: dict[str, set[str]] = {
    T.RDF: set("type first rest nil value subject predicate object Property Statement List Bag Seq Alt langString XMLLiteral HTML JSON PlainLiteral direction language".split()),
    T.RDFS: set("Class Resource Literal Datatype Container ContainerMembershipProperty member label comment seeAlso isDefinedBy subClassOf subPropertyOf domain range".split()),
    T.OWL: set("Class Thing Nothing Ontology ObjectProperty DatatypeProperty AnnotationProperty FunctionalProperty InverseFunctionalProperty TransitiveProperty SymmetricProperty NamedIndividual Restriction sameAs differentFrom equivalentClass equivalentProperty inverseOf versionIRI versionInfo imports priorVersion deprecated disjointWith unionOf intersectionOf complementOf oneOf onProperty someValuesFrom allValuesFrom hasValue minCardinality maxCardinality cardinality DeprecatedClass DeprecatedProperty backwardCompatibleWith incompatibleWith".split()),
    T.MD: set("FullModel Model Model.profile Model.Supersedes Model.DependentOn Model.created Model.scenarioTime Model.version Model.description Model.modelingAuthoritySet Model.effectiveDateTime".split()),
    T.DM: set("DifferenceModel forwardDifferences reverseDifferences preconditions".split()),
}
XSD_TYPES = set("string boolean decimal integer double float date time dateTime dateTimeStamp gYear gMonth gDay gYearMonth gMonthDay duration yearMonthDuration dayTimeDuration byte short int long unsignedByte unsignedShort unsignedInt unsignedLong positiveInteger nonNegativeInteger negativeInteger nonPositiveInteger hexBinary base64Binary anyURI language normalizedString token NMTOKEN Name NCName".split())


def vocabulary_status(iri: str) -> bool | None:
    """True: a known vocabulary term, False: a typo in a closed vocabulary, None: another namespace."""
    for ns, names in VOCABULARY.items():
        if iri.startswith(ns):
            local = iri[len(ns) :]
            return local in names or ns == T.RDF and local.startswith("_") and local[1:].isdigit()
    if iri.startswith(T.XSD):
        return iri[len(T.XSD) :] in XSD_TYPES
    return None


STRINGS = {T.STRING, T.LANG_STRING, T.XSD + "normalizedString", T.XSD + "token", T.XSD + "anyURI", T.RDFS + "Literal"}


def compatible(literal: str, wanted: str) -> bool:
    """Numbers agree with numbers, string-like types with each other, all else must be equal."""
    if literal in T.NUMERIC and wanted in T.NUMERIC or literal in STRINGS and wanted in STRINGS:
        return True
    return literal == wanted or wanted == T.RDFS + "Literal"


def is_datatype(iri: str) -> bool:
    return iri.startswith(T.XSD) or iri in (T.LANG_STRING, T.RDFS + "Literal")
