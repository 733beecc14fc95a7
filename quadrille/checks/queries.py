"""Static checks of SPARQL queries and updates."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from typing import Any

from .. import terms as T
from ..plans import algebra as A
from ..plans.parser import Parser, SparqlSyntaxError
from ..terms import Iri, Literal, Var
from .model import Finding, Schema, compatible, is_datatype, vocabulary_status

DEFAULT_PREFIXES = {"rdf": T.RDF, "rdfs": T.RDFS, "owl": T.OWL, "xsd": T.XSD, "sh": T.SH, "md": T.MD, "dm": T.DM}


@dataclass(frozen=True)
class Ref:
    """A triple of a pattern: graph, scope chain (branches of UNION, OPTIONAL, MINUS, EXISTS) and origin."""

    s: Any
    p: Any
    o: Any
    graph: Any
    scope: tuple[int, ...]
    mandatory: bool
    negated: bool = False


class Analysis:
    """References of a query, in order."""

    def __init__(self, parsed: A.Query | list[A.Update]):
        self.refs: list[Ref] = []
        self.constants: list[Iri] = []
        self.compared: list[tuple[str, Iri]] = []
        self.graphs: list[str] = []
        self.dynamic: list[str] = []
        self.scopes = 0
        if isinstance(parsed, A.Query):
            self.query(parsed, None, ())
        else:
            for u in parsed:
                self.update(u)

    def query(self, q: A.Query, graph, scope) -> None:
        self.graphs += q.graphs + q.named
        self.walk(q.where, graph, scope, True)
        for _, e in [*(q.select or []), *(q.group or [])]:
            self.expr(e, graph, scope)
        for e in [*q.having, *(e for _, e in q.order)]:
            self.expr(e, graph, scope)
        for g, t in q.template:
            self.add(t, g, (*scope, self.fresh()), False)

    def update(self, u: A.Update) -> None:
        g = Iri(u.with_graph) if u.with_graph else None
        self.graphs += [x for x in (u.with_graph, u.source if u.kind != "LOAD" else None, u.target) if x and "://" in x] + u.using + u.using_named
        self.walk(u.where, g, (), True)
        for at, t in u.deletes + u.inserts:
            self.graphs += [at.value] if isinstance(at, Iri) else []
            self.add(t, at or g, (self.fresh(),), False)

    def fresh(self) -> int:
        self.scopes += 1
        return self.scopes

    def add(self, t: A.Triple, graph, scope, mandatory, negated=False) -> None:
        self.refs.append(Ref(t.s, t.p, t.o, graph, scope, mandatory, negated))

    def walk(self, p, graph, scope, mandatory, negated=False) -> None:
        if p is None or isinstance(p, (A.Empty, A.Values, A.Frame)):
            return
        if isinstance(p, A.Bgp):
            for t in p.triples:
                self.add(t, graph, scope, mandatory, negated)
        elif isinstance(p, (A.Join, A.Lateral)):
            self.walk(p.left, graph, scope, mandatory, negated)
            self.walk(p.right, graph, scope, mandatory, negated)
        elif isinstance(p, A.LeftJoin):
            self.walk(p.left, graph, scope, mandatory, negated)
            inner = (*scope, self.fresh())
            self.walk(p.right, graph, inner, False, negated)
            self.expr(p.condition, graph, inner)
        elif isinstance(p, A.Union):
            self.walk(p.left, graph, (*scope, self.fresh()), mandatory, negated)
            self.walk(p.right, graph, (*scope, self.fresh()), mandatory, negated)
        elif isinstance(p, (A.Minus, A.SemiJoin)):
            self.walk(p.left, graph, scope, mandatory, negated)
            self.walk(p.right, graph, (*scope, self.fresh()), False, isinstance(p, A.Minus) or p.anti)
        elif isinstance(p, A.Filter):
            self.walk(p.pattern, graph, scope, mandatory, negated)
            self.expr(p.condition, graph, scope)
        elif isinstance(p, A.Extend):
            self.walk(p.pattern, graph, scope, mandatory, negated)
            self.expr(p.expr, graph, scope)
        elif isinstance(p, A.Graph):
            if isinstance(p.name, Iri):
                self.graphs.append(p.name.value)
            self.walk(p.pattern, p.name, scope, mandatory, negated)
        elif isinstance(p, A.SubQuery):
            self.query(p.query, graph, (*scope, self.fresh()))
        # SERVICE: another schema, not looked into

    def expr(self, e, graph, scope) -> None:
        if not isinstance(e, tuple):
            return
        if e[0] == "exists":
            self.walk(e[2], graph, (*scope, self.fresh()), False, e[1])
        elif e[0] == "term" and isinstance(e[1], Iri):
            self.constants.append(e[1])
        elif e[0] in ("op", "call"):
            if e[0] == "op" and e[1] in ("=", "IN", "!="):
                names = [x[1] for x in e[2] if x[0] == "var"]
                for x in e[2]:
                    if x[0] == "term" and isinstance(x[1], Iri) and len(names) == 1:
                        self.compared.append((names[0], x[1]))
            for x in e[2]:
                self.expr(x, graph, scope)
        elif e[0] == "agg":
            self.expr(e[3], graph, scope)


def leaves(p: Any) -> list[str]:
    """Predicates of a path."""
    if isinstance(p, Iri):
        return [p.value]
    if isinstance(p, A.Link):
        return [p.iri]
    if isinstance(p, (A.Inverse, A.Repeat)):
        return leaves(p.path)
    if isinstance(p, (A.Seq, A.Alt)):
        return [x for y in p.parts for x in leaves(y)]
    if isinstance(p, A.Negated):
        return [*p.forward, *(p.backward or ())]
    return []


def chain(p: Any) -> list[tuple[str, bool]] | None:
    """(predicate, inverted) steps of a plain sequence, None for other paths."""
    if isinstance(p, Iri):
        return [(p.value, False)]
    if isinstance(p, A.Link):
        return [(p.iri, False)]
    if isinstance(p, A.Inverse) and isinstance(p.path, A.Link):
        return [(p.path.iri, True)]
    if isinstance(p, A.Seq):
        parts = [chain(x) for x in p.parts]
        return None if any(x is None for x in parts) else [s for x in parts for s in x]
    return None


def inject_prefixes(text: str, prefixes: dict[str, str] | None = None) -> tuple[str, int]:
    """The text with default prefixes that it uses but doesn't declare, and the number of lines added."""
    known = {**DEFAULT_PREFIXES, **(prefixes or {})}
    declared = {m.lower() for m in re.findall(r"(?i)\bprefix\s+([\w.-]*):", text)}
    bare = re.sub(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|<[^>\s]*>|#[^\n]*', " ", text)
    used = set(re.findall(r"(?<![\w.])([A-Za-z][\w.-]*|):[\w%]", bare))
    missing = [f"PREFIX {k}: <{v}>" for k, v in sorted(known.items()) if k in used and k.lower() not in declared]
    return "\n".join([*missing, text]), len(missing)


def split_queries(text: str) -> list[str]:
    """Several queries separated by lines of ``;`` alone; prefixes carry over."""
    parts, out, prologue = re.split(r"(?m)^\s*;\s*$", text), [], ""
    for p in parts:
        if p.strip():
            out.append(prologue + p)
            prologue += "".join(m[0] + "\n" for m in re.finditer(r"(?im)^\s*(?:prefix\s+[\w.-]*:\s*<[^>]*>|base\s+<[^>]*>)", p))
    return out


class QueryChecker:
    def __init__(self, schema: Schema, scope: set[str] | None = None, graphs: dict[str, set[str]] | None = None, prefixes: dict[str, str] | None = None):
        """``graphs``: configured graph -> profiles in scope there; None: graphs aren't checked."""
        self.schema, self.scope, self.graphs, self.prefixes = schema, scope, graphs, prefixes

    def check(self, text: str) -> list[Finding]:
        injected, shift = inject_prefixes(text, self.prefixes)
        try:
            parser = Parser(injected)
            try:
                parsed: Any = parser.query()
            except SparqlSyntaxError as first:
                parser = Parser(injected)
                try:
                    parsed = parser.updates()
                except SparqlSyntaxError:
                    parts = split_queries(text)
                    if len(parts) > 1:
                        return [f for p in parts for f in self.check(p)]
                    raise first from None
        except SparqlSyntaxError as e:
            return [Finding("SYNTAX_ERROR", str(e), line=max(1, e.line - shift), column=e.column)]
        where: dict[str, tuple[int, int]] = {}
        for t, at in parser.positions:
            line = injected.count("\n", 0, at) + 1 - shift
            where.setdefault(t.value, (line, at - injected.rfind("\n", 0, at)))
        out = self.run(parsed)
        located = [Finding(f.code, f.message, f.term, *where.get(f.term or "", (None, None)), f.graph, f.profiles, f.elsewhere, f.hint, f.severity) for f in out]
        return list(dict.fromkeys(located))

    def scope_of(self, graph: Any) -> set[str] | None:
        """Profiles in scope in a graph; an unknown graph has none."""
        if self.graphs is None or graph is None or isinstance(graph, Var):
            return self.scope
        return self.graphs.get(graph.value, set())

    def run(self, parsed: Any) -> list[Finding]:
        a, out = Analysis(parsed), []
        s = self.schema
        if self.graphs is not None:
            out += [Finding("GRAPH_NOT_CONFIGURED", f"Graph <{g}> is not configured", g, graph=g) for g in a.graphs if g not in self.graphs]
        types: dict[tuple[Any, tuple[int, ...]], set[str]] = {}
        for r in a.refs:
            if isinstance(r.p, Iri) and r.p.value == T.RDF_TYPE and isinstance(r.o, Iri):
                types.setdefault((r.s, r.scope), set()).add(r.o.value)
        implied: dict[Any, list[str]] = {}
        seen_optional = set()
        mandatory = Counter(v for r in a.refs if r.mandatory for v in (r.s, r.o) if isinstance(v, Var))
        for r in a.refs:
            scope = self.scope_of(r.graph)
            g = r.graph.value if isinstance(r.graph, Iri) else None
            if isinstance(r.p, Var):
                out.append(Finding("DYNAMIC_PREDICATE", f"The predicate ?{r.p.name} can't be checked", f"?{r.p.name}", graph=g))
                continue
            if isinstance(r.p, Iri) and r.p.value == T.RDF_TYPE:
                if isinstance(r.o, Var):
                    out.append(Finding("DYNAMIC_CLASS", f"The class ?{r.o.name} can't be checked", f"?{r.o.name}", graph=g))
                elif isinstance(r.o, Iri):
                    out += self.term(r.o.value, scope, g, "class")
                continue
            for p in leaves(r.p):
                out += self.term(p, scope, g, "property")
            out += self.chains(r, scope, g)
            if not isinstance(r.p, Iri):
                continue
            p = r.p.value
            domains = s.domains_of(p, scope)
            visible = {t for (x, sc), ts in types.items() if x == r.s and r.scope[: len(sc)] == sc for t in ts}
            if domains and visible and not any(s.is_a(c, d) for c in visible for d in domains):
                names = ", ".join(sorted(domains))
                out.append(Finding("PROPERTY_NOT_ALLOWED_FOR_CLASS", f"<{p}> belongs to {names}, not to {', '.join(sorted(visible))}", p, graph=g))
            if domains and not visible and isinstance(r.s, Var) and len(domains) == 1:
                implied.setdefault(r.s, []).append(next(iter(domains)))
            ranges = s.ranges_of(p, scope)
            if isinstance(r.o, Literal) and ranges:
                if not any(is_datatype(x) and compatible(r.o.dt, x) for x in ranges):
                    out.append(Finding("DATATYPE_MISMATCH", f"A literal of {r.o.dt} doesn't fit the range of <{p}>", p, graph=g, hint=", ".join(sorted(ranges))))
            members = s.enum_members(p, scope)
            if members is not None and isinstance(r.o, Iri) and r.o.value not in members:
                out.append(Finding("INVALID_ENUM_VALUE", f"<{r.o.value}> is no value of <{p}>", r.o.value, graph=g, hint=", ".join(sorted(members))))
            m = s.multiplicity(p, scope)
            if m and m[0] == 0 and r.mandatory and not r.negated and isinstance(r.o, Var) and (p, r.s) not in seen_optional and mandatory[r.o] <= 1:
                seen_optional.add((p, r.s))
                out.append(Finding("PROPERTY_MAY_BE_ABSENT", f"<{p}> is optional in the schema, but required here", p, graph=g, hint="OPTIONAL"))
        for v, classes in implied.items():
            best = [c for c in set(classes) if all(s.related(c, d) for d in classes)]
            if best:
                narrow = max(best, key=lambda c: len(s.supers.get(c, ())))
                out.append(Finding("QUERY_IMPLIED_TYPE", f"?{v.name} is implied to be a {narrow}", narrow))
        by_var = {}
        for r in a.refs:
            if isinstance(r.o, Var) and isinstance(r.p, Iri):
                by_var.setdefault(r.o.name, []).append((r.p.value, self.scope_of(r.graph)))
        handled = set()
        for name, iri in a.compared:
            for p, scope in by_var.get(name, []):
                members = s.enum_members(p, scope)
                if members is not None:
                    handled.add(iri)
                    if iri.value not in members:
                        out.append(Finding("INVALID_ENUM_VALUE", f"<{iri.value}> is no value of <{p}>", iri.value))
        known_ns = {re.sub(r"[^#/]*$", "", x) for x in [*s.classes, *s.properties]}
        for iri in a.constants:
            known = s.is_class(iri.value, self.scope) or s.is_property(iri.value, self.scope) or s.is_member(iri.value, self.scope)
            status = vocabulary_status(iri.value)
            if iri not in handled and not known and (status is False or status is None and re.sub(r"[^#/]*$", "", iri.value) in known_ns):
                out.append(Finding("UNKNOWN_TERM_IN_EXPRESSION", f"<{iri.value}> is not in the schema", iri.value))
        if isinstance(parsed, A.Query):
            out += variables(parsed)
        return out

    def term(self, iri: str, scope: set[str] | None, graph: str | None, kind: str) -> list[Finding]:
        s = self.schema
        if (s.is_class if kind == "class" else s.is_property)(iri, scope):
            return []
        status = vocabulary_status(iri)
        if status:
            return []
        if status is False:
            return [Finding("UNKNOWN_VOCABULARY_TERM", f"<{iri}> is not a term of its vocabulary", iri, graph=graph)]
        if kind == "class" and s.is_member(iri, scope):
            return [Finding("ENUM_USED_AS_CLASS", f"<{iri}> is an enumeration value, not a class", iri, graph=graph)]
        elsewhere = (s.classes if kind == "class" else s.properties).get(iri, set())
        more = f"; it is declared in {', '.join(sorted(elsewhere))}" if elsewhere else ""
        return [Finding(f"UNKNOWN_{kind.upper()}", f"Unknown {kind} <{iri}>{more}", iri, graph=graph, profiles=tuple(sorted(scope or ())), elsewhere=tuple(sorted(elsewhere)))]

    def chains(self, r: Ref, scope: set[str] | None, graph: str | None) -> list[Finding]:
        """Ranges of a step must meet domains of the next; steps of unknown ends are passed over."""
        steps, out, s = chain(r.p), [], self.schema
        for (p, pi), (q, qi) in zip(steps or [], (steps or [])[1:]):
            left = s.domains_of(p, scope) if pi else s.ranges_of(p, scope)
            right = s.ranges_of(q, scope) if qi else s.domains_of(q, scope)
            if left and right and not any(s.related(a, b) for a in left for b in right):
                out.append(Finding("PATH_CHAIN_MISMATCH", f"<{q}> doesn't apply to what <{p}> leads to", q, graph=graph))
        return out


def variables(q: A.Query) -> list[Finding]:
    """Projected but never bound, and bound once but never used."""
    out: list[Finding] = []
    uses: Counter[str] = Counter()
    binds: dict[str, None] = {}

    def expr(e):
        if isinstance(e, tuple) and e and e[0] == "exists":
            walk(e[2])
        elif isinstance(e, tuple) and e and e[0] == "var":
            uses[e[1]] += 1
        elif isinstance(e, (tuple, list)):
            for x in e:
                expr(x)

    def see(x):
        if isinstance(x, Var) and not x.name.startswith("_:"):
            uses[x.name] += 1
            binds.setdefault(x.name)

    def walk(p):
        if isinstance(p, A.Bgp):
            for t in p.triples:
                see(t.s), see(t.p), see(t.o)
        elif isinstance(p, A.Extend):
            walk(p.pattern)
            see(p.var)
            expr(p.expr)
        elif isinstance(p, A.Values):
            for v in p.vars:
                see(v)
        elif isinstance(p, A.SubQuery):
            inner = p.query
            for v in [v for v, _ in inner.select] if inner.select is not None else A.pattern_vars(inner.where):
                see(v)
            out.extend(variables(inner))
        elif p is not None:
            for name in ("left", "right", "pattern"):
                if hasattr(p, name):
                    walk(getattr(p, name))
            if isinstance(p, (A.Graph, A.Service)):
                see(p.name)
            if isinstance(p, (A.Filter, A.LeftJoin)):
                expr(p.condition)

    walk(q.where)
    if q.values:
        for v in q.values.vars:
            see(v)
    for v, e in q.group or []:
        uses[v.name] += 1
        if e is not None:
            binds.setdefault(v.name)
        expr(e)
    for e in q.having:
        expr(e)
    for _, e in q.order:
        expr(e)
    for _, t in q.template:
        for x in (t.s, t.p, t.o):
            if isinstance(x, Var):
                uses[x.name] += 1
    for x in q.describe or []:
        if isinstance(x, Var):
            uses[x.name] += 1
    if q.form == "SELECT" and q.select is not None:
        for v, e in q.select:
            if e is None:
                uses[v.name] += 1
                if v.name not in binds:
                    out.append(Finding("UNBOUND_PROJECTION", f"?{v.name} is selected but never bound", f"?{v.name}"))
            else:
                expr(e)
        out += [Finding("UNUSED_VARIABLE", f"?{n} is used only once", f"?{n}") for n in binds if uses[n] == 1]
    return out


def dependencies(text: str, schema: Schema, prefixes: dict[str, str] | None = None) -> dict[str, set[str]]:
    """Profiles, classes, properties and graphs that a query needs."""
    injected, _ = inject_prefixes(text, prefixes)
    from ..plans.parser import parse

    a = Analysis(parse(injected))
    classes = {r.o.value for r in a.refs if isinstance(r.p, Iri) and r.p.value == T.RDF_TYPE and isinstance(r.o, Iri) and r.o.value in schema.classes}
    properties = {p for r in a.refs for p in leaves(r.p) if p in schema.properties}
    needed = [schema.classes[c] for c in sorted(classes)] + [schema.properties[p] for p in sorted(properties)]
    return {"profiles": set().union(*needed) if needed else set(), "classes": classes, "properties": properties, "graphs": set(a.graphs)}


def infer_scope(text: str, schema: Schema, prefixes: dict[str, str] | None = None) -> set[str]:
    return dependencies(text, schema, prefixes)["profiles"] or schema.profiles
