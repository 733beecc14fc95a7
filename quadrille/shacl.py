"""SHACL validation of quads: every constraint is one DataFrame over (focus, value) pairs.

Shapes are read on the driver (they are schema-sized); data never leaves the
cluster. The default graph is the union of all graphs.
"""

from __future__ import annotations

import re
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import terms as T
from .dataset import QuadDataset
from .functions.values import Value, less, literal, term, term_literal
from .operators.relation import Relation
from .plans import algebra as A
from .plans.compiler import Compiler, Context
from .plans.parser import parse_query
from .session import staged
from .sources.text import parse_turtle
from .terms import BNode, Iri, Var

SH = T.SH
RESULT = f"focus {T.TERM_TYPE}, path string, value {T.TERM_TYPE}, component string, severity string, shape string, message string"
NODE_KINDS = {"IRI": (1,), "BlankNode": (2,), "Literal": (3,), "BlankNodeOrIRI": (1, 2), "BlankNodeOrLiteral": (2, 3), "IRIOrLiteral": (1, 3)}
LEXICAL = {
    T.INTEGER: r"^[+-]?\d+$", T.DECIMAL: r"^[+-]?(\d+(\.\d*)?|\.\d+)$", T.DOUBLE: r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|INF|-INF|NaN)$", T.FLOAT: r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|INF|-INF|NaN)$",
    T.BOOLEAN: "^(true|false|0|1)$", T.DATE: r"^-?\d{4,}-\d\d-\d\d(Z|[+-]\d\d:\d\d)?$", T.DATETIME: r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$",
    **{t: r"^[+-]?\d+$" for t in T.INTEGERS},
}


class Shapes:
    """A shapes graph on the driver: subject -> predicate -> objects."""

    def __init__(self, triples: list[tuple]):
        self.by: dict[T.Term, dict[str, list[T.Term]]] = {}
        for s, p, o in triples:
            self.by.setdefault(s, {}).setdefault(p.value, []).append(o)

    @staticmethod
    def turtle(text: str) -> Shapes:
        return Shapes([(s, p, o) for _, s, p, o in parse_turtle(text)[0]])

    def all(self, s: T.Term, p: str) -> list[T.Term]:
        return self.by.get(s, {}).get(p if "://" in p else SH + p, [])

    def one(self, s: T.Term, p: str) -> T.Term | None:
        found = self.all(s, p)
        return found[0] if found else None

    def items(self, head: T.Term) -> list[T.Term]:
        out = []
        while head in self.by and head != Iri(T.RDF + "nil"):
            out += self.all(head, T.RDF + "first")
            head = (self.all(head, T.RDF + "rest") or [Iri(T.RDF + "nil")])[0]
        return out

    def lists(self, s: T.Term, p: str) -> list[list[T.Term]]:
        return [self.items(o) for o in self.all(s, p)]

    def deactivated(self, s: T.Term) -> bool:
        return any(o.value in ("true", "1") for o in self.all(s, "deactivated"))

    def path(self, x: T.Term):
        """A SHACL path as an algebra path."""
        if isinstance(x, Iri) and x not in self.by or isinstance(x, Iri) and not any(k.startswith(SH) and k.endswith("Path") for k in self.by[x]) and T.RDF + "first" not in self.by[x]:
            return A.Link(x.value)
        if self.all(x, T.RDF + "first"):
            return A.Seq(tuple(self.path(y) for y in self.items(x)))
        for name, make in (
            ("inversePath", A.Inverse),
            ("zeroOrMorePath", lambda p: A.Repeat(p, 0, None)),
            ("oneOrMorePath", lambda p: A.Repeat(p, 1, None)),
            ("zeroOrOnePath", lambda p: A.Repeat(p, 0, 1)),
        ):
            if self.all(x, name):
                return make(self.path(self.one(x, name)))
        if self.all(x, "alternativePath"):
            return A.Alt(tuple(self.path(y) for y in self.items(self.one(x, "alternativePath"))))
        raise ValueError(f"no path: {x}")

    def targeted(self) -> list[T.Term]:
        """Shapes with a target of their own, or that are classes."""
        keys = [SH + k for k in ("targetClass", "targetNode", "targetSubjectsOf", "targetObjectsOf", "target")]
        implicit = lambda s, ps: any(o.value in (T.RDFS + "Class", T.OWL + "Class") for o in ps.get(T.RDF_TYPE, [])) and any(o.value in (SH + "NodeShape", SH + "PropertyShape") for o in ps.get(T.RDF_TYPE, []))
        return [s for s, ps in self.by.items() if any(k in ps for k in keys) or implicit(s, ps)]


def path_text(p) -> str:
    """SPARQL syntax of a path."""
    if isinstance(p, A.Link):
        return f"<{p.iri}>"
    if isinstance(p, A.Inverse):
        return f"^({path_text(p.path)})"
    if isinstance(p, A.Seq):
        return "(" + "/".join(map(path_text, p.parts)) + ")"
    if isinstance(p, A.Alt):
        return "(" + "|".join(map(path_text, p.parts)) + ")"
    return f"({path_text(p.path)})" + {(0, None): "*", (1, None): "+", (0, 1): "?"}[(p.least, p.most)]


def sparql_term(t: T.Term) -> str:
    if isinstance(t, Iri):
        return f"<{t.value}>"
    quoted = '"' + t.value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    return quoted + (f"@{t.lang}" if t.lang else f"^^<{t.dt}>")


class Validator:
    def __init__(self, data: QuadDataset, shapes: Shapes):
        self.shapes = shapes
        merged = data.quads.select(F.lit(None).cast("string").alias("g"), "s", "p", "o").dropDuplicates(["s", "p", "o"])
        self.data = QuadDataset(merged, data.prefixes)
        self.compiler = Compiler(self.data)
        self.triples = merged
        self._closure: DataFrame | None = None
        self.components = self._components()

    # nodes
    def typed(self) -> DataFrame:
        """(node, class): types with all superclasses."""
        if self._closure is None:
            sub = self.triples.filter(F.col("p") == T.RDFS + "subClassOf").select(F.col("s").alias("c"), F.col("o.v").alias("d"))
            from .operators.paths import superclasses

            types = self.triples.filter(F.col("p") == T.RDF_TYPE).select(term(Value("node", F.col("s"))).alias("node"), F.col("o.v").alias("c"))
            if sub.isEmpty():
                self._closure = types.select("node", F.col("c").alias("class")).distinct()
            else:
                up = superclasses(sub)
                self._closure = staged(types.select("node", F.col("c").alias("class")).union(types.join(up, "c").select("node", F.col("d").alias("class"))).distinct(), "types")
        return self._closure

    def constants(self, nodes: list[T.Term]) -> DataFrame:
        spark = self.data.spark
        rows = [(T.term_tuple(n),) if not isinstance(n, BNode) else ((T.BNODE_KIND, T.node_string(n), None, None),) for n in nodes]
        return spark.createDataFrame(rows, f"node {T.TERM_TYPE}")

    def focus(self, s: T.Term) -> DataFrame:
        """(focus) of a shape's targets."""
        sh, out = self.shapes, []
        classes = sh.all(s, "targetClass")
        if any(o.value in (T.RDFS + "Class", T.OWL + "Class") for o in sh.all(s, T.RDF_TYPE)):
            classes = [*classes, s]
        if classes:
            out.append(self.typed().filter(F.col("class").isin([c.value for c in classes])).select("node"))
        if sh.all(s, "targetNode"):
            out.append(self.constants(sh.all(s, "targetNode")))
        subject, ps = term(Value("node", F.col("s"))), F.col("p")
        if sh.all(s, "targetSubjectsOf"):
            out.append(self.triples.filter(ps.isin([p.value for p in sh.all(s, "targetSubjectsOf")])).select(subject.alias("node")))
        if sh.all(s, "targetObjectsOf"):
            out.append(self.triples.filter(ps.isin([p.value for p in sh.all(s, "targetObjectsOf")])).select(F.col("o").alias("node")))
        for t in sh.all(s, "target"):
            q = sh.one(t, "select")
            if q is not None:
                rel = self.compiler.solutions(parse_query(self.prefixed(t, q.value)), Context())
                out.append(rel.df.select(term(rel.lookup("this")).alias("node")))
        return reduce(DataFrame.union, out).filter("node is not null").distinct().toDF("focus")

    def values(self, s: T.Term, focus: DataFrame) -> tuple[DataFrame, str | None]:
        """(focus, value) pairs of a shape, distinct; node shapes: the focus itself."""
        path = self.shapes.one(s, "path")
        if path is None:
            return focus.select("focus", F.col("focus").alias("value")), None
        p = self.shapes.path(path)
        return self.along(focus, p), p.iri if isinstance(p, A.Link) else path_text(p)

    def along(self, focus: DataFrame, p) -> DataFrame:
        rel = self.compiler.path(Var("x"), p, Var("y"), Context())
        pairs = rel.df.select(term(rel.lookup("x")).alias("focus"), term(rel.lookup("y")).alias("value")).distinct()
        return focus.join(pairs, "focus").select("focus", "value")

    # validation
    def report(self) -> DataFrame:
        """All results; empty: the data conform."""
        out = [r for s in self.shapes.targeted() if not self.shapes.deactivated(s) for r in self.shape(s, self.focus(s))]
        spark = self.data.spark
        return reduce(DataFrame.union, out) if out else spark.createDataFrame([], RESULT)

    def shape(self, s: T.Term, focus: DataFrame) -> list[DataFrame]:
        if self.shapes.deactivated(s):
            return []
        sh, out = self.shapes, []
        values, path = self.values(s, focus)
        severity = (sh.one(s, "severity") or Iri(SH + "Violation")).value
        messages = sh.all(s, "message")
        me = s.value if isinstance(s, Iri) else f"_:{s.label}"

        def result(df: DataFrame, component: str, text: str, value: bool = True, severity_=severity, message: Column | None = None):
            v = F.col("value") if value else F.lit(None).cast(T.TERM_TYPE)
            m = message if message is not None else F.lit(messages[0].value if messages else text)
            out.append(df.select("focus", F.lit(path).cast("string").alias("path"), v.alias("value"), F.lit(SH + component).alias("component"), F.lit(severity_).alias("severity"), F.lit(me).alias("shape"), m.alias("message")))

        v = Value("term", F.col("value"))
        k, lex, dt = F.col("value.k"), F.col("value.v"), F.col("value.dt")

        def failing(condition: Column) -> DataFrame:
            """Values that don't surely satisfy the condition."""
            return values.filter(~F.coalesce(condition, F.lit(False)))

        for c in sh.all(s, "class"):
            member = self.typed().filter(F.col("class") == c.value).select(F.col("node").alias("value"))
            result(values.join(member, "value", "left_anti"), "ClassConstraintComponent", f"Not a {c.value}")
        for d in sh.all(s, "datatype"):
            ok = (k == T.LITERAL_KIND) & (dt == d.value)
            if d.value in LEXICAL:
                ok = ok & lex.rlike(LEXICAL[d.value])
            result(failing(ok), "DatatypeConstraintComponent", f"Not of datatype {d.value}")
        for n in sh.all(s, "nodeKind"):
            result(failing(k.isin(*NODE_KINDS[n.value[len(SH) :]])), "NodeKindConstraintComponent", f"Not of kind {n.value[len(SH):]}")
        for name, op in (("minInclusive", ">="), ("minExclusive", ">"), ("maxInclusive", "<="), ("maxExclusive", "<")):
            for b in sh.all(s, name):
                result(failing(less(v, literal(b), op)), f"{name[0].upper()}{name[1:]}ConstraintComponent", f"Not {op} {b.value}")
        length = F.when(k != T.BNODE_KIND, F.char_length(lex))
        for b in sh.all(s, "minLength"):
            result(failing(length >= int(b.value)), "MinLengthConstraintComponent", f"Shorter than {b.value}")
        for b in sh.all(s, "maxLength"):
            result(failing(length <= int(b.value)), "MaxLengthConstraintComponent", f"Longer than {b.value}")
        for b in sh.all(s, "pattern"):
            flags = "".join(f.value for f in sh.all(s, "flags"))
            pattern = "".join(f"(?{f})" for f in flags if f in "ismx") + (re.escape(b.value) if "q" in flags else b.value)
            result(failing((k != T.BNODE_KIND) & lex.rlike(pattern)), "PatternConstraintComponent", f"Doesn't match {b.value}")
        for tags in sh.lists(s, "languageIn"):
            lang = F.lower(F.col("value.lang"))
            ok = reduce(lambda a, b: a | b, [(lang == t.value.lower()) | lang.startswith(t.value.lower() + "-") for t in tags], F.lit(False))
            result(failing(ok), "LanguageInConstraintComponent", "Language not allowed")
        for allowed in sh.lists(s, "in"):
            options = self.constants(allowed).select(F.col("node").alias("value")) if allowed else None
            result(values.join(F.broadcast(options), "value", "left_anti") if options is not None else values, "InConstraintComponent", "Not an allowed value")
        # whole value sets of a focus
        counts = lambda: focus.join(values.groupBy("focus").agg(F.count("value").alias("n")), "focus", "left").select("focus", F.coalesce("n", F.lit(0)).alias("n"))
        for b in sh.all(s, "minCount"):
            if int(b.value) > 0:
                result(counts().filter(F.col("n") < int(b.value)), "MinCountConstraintComponent", f"Fewer than {b.value} values", value=False)
        for b in sh.all(s, "maxCount"):
            result(counts().filter(F.col("n") > int(b.value)), "MaxCountConstraintComponent", f"More than {b.value} values", value=False)
        for b in sh.all(s, "hasValue"):
            with_it = values.filter(F.col("value") == (term_literal(b))).select("focus")
            result(focus.join(with_it, "focus", "left_anti"), "HasValueConstraintComponent", f"Lacks {sparql_term(b)}", value=False)
        if any(x.value in ("true", "1") for x in sh.all(s, "uniqueLang")):
            twice = values.filter("value.lang is not null").groupBy("focus", F.lower("value.lang").alias("l")).count().filter("count > 1")
            result(twice, "UniqueLangConstraintComponent", "A language is used twice", value=False)
        for p in sh.all(s, "equals"):
            other = self.along(focus, A.Link(p.value))
            for a, b in ((values, other), (other, values)):
                result(a.join(b, ["focus", "value"], "left_anti"), "EqualsConstraintComponent", f"Differs from {p.value}")
        for p in sh.all(s, "disjoint"):
            result(values.join(self.along(focus, A.Link(p.value)), ["focus", "value"], "left_semi"), "DisjointConstraintComponent", f"Shared with {p.value}")
        for name, op in (("lessThan", "<"), ("lessThanOrEquals", "<=")):
            for p in sh.all(s, name):
                other = self.along(focus, A.Link(p.value)).select(F.col("focus").alias("f2"), F.col("value").alias("w"))
                both = values.join(other, F.col("focus") == F.col("f2"))
                result(both.filter(~F.coalesce(less(v, Value("term", F.col("w")), op), F.lit(False))), f"{name[0].upper()}{name[1:]}ConstraintComponent", f"Not {op} {p.value}")
        # shapes
        as_focus = values.select(F.col("value").alias("focus")).distinct()
        for x in sh.all(s, "node"):
            result(self._bad(values, x, as_focus), "NodeConstraintComponent", "Doesn't conform to the node shape")
        for x in sh.all(s, "property"):
            out += self.shape(x, as_focus)
        for x in sh.all(s, "not"):
            bad = self.violating(x, as_focus)
            result(values.join(bad.select(F.col("focus").alias("value")), "value", "left_anti"), "NotConstraintComponent", "Conforms to what it must not")
        for name, component in (("and", "And"), ("or", "Or"), ("xone", "Xone")):
            for members in sh.lists(s, name):
                flags = self.conformance(members, as_focus)
                n = reduce(lambda a, b: a + b, [F.col(f"c{i}").cast("int") for i in range(len(members))], F.lit(0))
                wrong = {"and": n < len(members), "or": n == 0, "xone": n != 1}[name]
                bad = flags.filter(wrong).select(F.col("focus").alias("value"))
                result(values.join(bad, "value", "left_semi"), f"{component}ConstraintComponent", f"Violates sh:{name}")
        for x in sh.all(s, "qualifiedValueShape"):
            self._qualified(s, x, focus, values, as_focus, result)
        if any(x.value in ("true", "1") for x in sh.all(s, "closed")):
            allowed = {o.value for p in sh.all(s, "property") if isinstance(o := sh.one(p, "path"), Iri)} | {o.value for ps in sh.lists(s, "ignoredProperties") for o in ps}
            extra = self.triples.filter(~F.col("p").isin(sorted(allowed))) if allowed else self.triples
            found = as_focus.join(extra.select(term(Value("node", F.col("s"))).alias("focus"), "p", F.col("o").alias("value")), "focus")
            out.append(found.select("focus", F.col("p").alias("path"), "value", F.lit(SH + "ClosedConstraintComponent").alias("component"), F.lit(severity).alias("severity"), F.lit(me).alias("shape"), F.lit(messages[0].value if messages else "The shape is closed").alias("message")))
        for x in sh.all(s, "sparql"):
            if not sh.deactivated(x):
                self._sparql(s, x, sh.one(x, "select").value, {}, focus, result)
        for c, params in self.components:
            bound = {n: sh.one(s, p) for n, p, _ in params}
            if all(bound[n] is not None or optional for n, _, optional in params) and any(bound.values()):
                self._custom(s, c, {n: t for n, t in bound.items() if t is not None}, focus, values, result)
        return out

    def violating(self, s: T.Term, focus: DataFrame) -> DataFrame:
        """(focus) that have a result for the shape."""
        found = self.shape(s, focus)
        return reduce(DataFrame.union, found).select("focus").distinct() if found else focus.filter(F.lit(False))

    def _bad(self, values: DataFrame, x: T.Term, as_focus: DataFrame) -> DataFrame:
        return values.join(self.violating(x, as_focus).select(F.col("focus").alias("value")), "value", "left_semi")

    def conformance(self, members: list[T.Term], focus: DataFrame) -> DataFrame:
        """(focus, c0, c1, ...): whether each node conforms to each shape."""
        out = focus.distinct()
        for i, m in enumerate(members):
            bad = self.violating(m, focus).withColumn(f"b{i}", F.lit(True))
            out = out.join(bad, "focus", "left").withColumn(f"c{i}", F.col(f"b{i}").isNull()).drop(f"b{i}")
        return out

    def _qualified(self, s, x, focus, values, as_focus, result) -> None:
        sh = self.shapes
        conforming = as_focus.join(self.violating(x, as_focus), "focus", "left_anti").select(F.col("focus").alias("value"))
        if any(y.value in ("true", "1") for y in sh.all(s, "qualifiedValueShapesDisjoint")):
            parents = [p for p, ps in sh.by.items() if s in ps.get(SH + "property", [])]
            siblings = {q for p in parents for y in sh.all(p, "property") if y != s for q in sh.all(y, "qualifiedValueShape") if q != x}
            for q in siblings:
                conforming = conforming.join(as_focus.join(self.violating(q, as_focus), "focus", "left_anti").select(F.col("focus").alias("value")), "value", "left_anti")
        n = values.join(conforming, "value", "left_semi").groupBy("focus").agg(F.count(F.lit(1)).alias("n"))
        counted = focus.join(n, "focus", "left").select("focus", F.coalesce("n", F.lit(0)).alias("n"))
        for b in sh.all(s, "qualifiedMinCount"):
            result(counted.filter(F.col("n") < int(b.value)), "QualifiedMinCountConstraintComponent", f"Fewer than {b.value} qualified values", value=False)
        for b in sh.all(s, "qualifiedMaxCount"):
            result(counted.filter(F.col("n") > int(b.value)), "QualifiedMaxCountConstraintComponent", f"More than {b.value} qualified values", value=False)

    # SPARQL
    def prefixed(self, x: T.Term, text: str) -> str:
        sh, lines = self.shapes, []
        for p in sh.all(x, "prefixes"):
            for d in sh.all(p, "declare"):
                lines.append(f"PREFIX {sh.one(d, 'prefix').value}: <{sh.one(d, 'namespace').value}>")
        return "\n".join(lines) + "\n" + text

    def _query(self, s, x, text: str, params: dict[str, T.Term]) -> A.Query:
        path = self.shapes.one(s, "path")
        if path is not None:
            text = re.sub(r"[$?]PATH\b", lambda m: path_text(self.shapes.path(path)), text)
        for n, t in params.items():
            text = re.sub(rf"[$?]{n}\b", lambda m, t=t: sparql_term(t), text)
        return parse_query(self.prefixed(x, text), self.data.prefixes)

    def _with(self, where, given: Relation):
        """The pattern with pre-bound variables joined inside its filters."""
        if isinstance(where, A.Filter):
            return A.Filter(where.condition, self._with(where.pattern, given))
        if isinstance(where, A.Extend):
            return A.Extend(self._with(where.pattern, given), where.var, where.expr)
        return A.Frame(given) if isinstance(where, A.Empty) else A.Join(A.Frame(given), where)

    def _sparql(self, s, x, text: str, params, focus: DataFrame, result) -> None:
        sh = self.shapes
        q = self._query(s, x, text, params)
        given = Relation.select(focus, {"this": Value("term", F.col("focus"), maybe=False)})
        rel = self.compiler.solutions(replace(q, where=self._with(q.where, given)), Context())
        value = term(rel.lookup("value")) if rel.lookup("value") else term(rel.lookup("this"))
        df = rel.df.select(term(rel.lookup("this")).alias("focus"), value.alias("value")).filter("focus is not null").distinct()
        message = sh.one(x, "message")
        severity = sh.one(x, "severity")
        kw = {"severity_": severity.value} if severity is not None else {}
        result(df, "SPARQLConstraintComponent", "Violates a SPARQL constraint", message=F.lit(message.value) if message is not None else None, **kw)

    def _components(self) -> list[tuple[T.Term, list[tuple[str, str, bool]]]]:
        sh, out = self.shapes, []
        for s, ps in sh.by.items():
            if any(o.value == SH + "ConstraintComponent" for o in ps.get(T.RDF_TYPE, [])):
                params = [(re.split(r"[#/]", sh.one(p, "path").value)[-1], sh.one(p, "path").value, any(o.value == "true" for o in sh.all(p, "optional"))) for p in sh.all(s, "parameter")]
                out.append((s, params))
        return out

    def _custom(self, s, c, params, focus, values, result) -> None:
        sh = self.shapes
        for v in sh.all(c, "validator") + sh.all(c, "propertyValidator" if sh.one(s, "path") is not None else "nodeValidator"):
            select, ask = sh.one(v, "select"), sh.one(v, "ask")
            if select is not None:
                self._sparql(s, v, select.value, params, focus, result)
            elif ask is not None:
                q = self._query(s, v, ask.value, params)
                given = Relation.select(values, {"this": Value("term", F.col("focus"), maybe=False), "value": Value("term", F.col("value"), maybe=False)})
                rel = self.compiler.pattern(self._with(q.where, given), Context())
                good = rel.df.select(term(rel.lookup("this")).alias("focus"), term(rel.lookup("value")).alias("value")).distinct()
                message = sh.one(v, "message")
                result(values.join(good, ["focus", "value"], "left_anti"), "SPARQLConstraintComponent", "Violates a constraint component", message=F.lit(message.value) if message is not None else None)


def validate(data: QuadDataset, shapes: Shapes | str) -> DataFrame:
    """Validation results (focus, path, value, component, severity, shape, message)."""
    return Validator(data, Shapes.turtle(shapes) if isinstance(shapes, str) else shapes).report()


def summary(report: DataFrame) -> DataFrame:
    """One row: conforms, violations, warnings, infos; unknown severities are violations."""
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    sev = F.col("severity")
    return report.agg(
        (F.count(F.lit(1)) == 0).alias("conforms"),
        count(~sev.isin(SH + "Warning", SH + "Info")).alias("violations"),
        count(sev == SH + "Warning").alias("warnings"),
        count(sev == SH + "Info").alias("infos"),
    )


__all__ = ["Shapes", "Validator", "summary", "validate"]
