"""SPARQL algebra to DataFrames.

Patterns on one subject over a mapped table become one scan; joins of mapped keys
run on native keys, not IRI strings; joins of different key spaces are empty; a
null-tolerant join is built only where a variable may really be unbound. All else
is left to Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T
from ..dataset import MappedDataset, QuadDataset
from ..functions.aggregates import aggregate
from ..functions.expressions import Evaluator
from ..functions.values import NUMBERS, Value, ebv, equal, lexical, literal, node, same_term, sort_keys, term
from ..operators import paths
from ..operators.relation import Relation, Slot, band_join, fresh, join, left_join, minus, semi, union
from ..terms import Iri, Var
from . import algebra as A
from .parser import parse_query
from .rewrite import alternatives, band, conjuncts as _conjuncts, exists_pattern, extreme, frames, has_exists as _has_exists, with_part


class Unsupported(NotImplementedError):
    pass


@dataclass(frozen=True)
class Context:
    """The active graph: None for the default graph, an IRI or a variable inside GRAPH."""

    graph: Var | Iri | None = None
    #: FROM and FROM NAMED; None: the dataset's own graphs
    default: tuple[str, ...] | None = None
    named: tuple[str, ...] | None = None


@dataclass
class Compiler:
    dataset: QuadDataset | MappedDataset
    functions: dict[str, Callable[..., Value]] = field(default_factory=dict)
    #: SERVICE: (endpoint IRI, query text, variables) -> DataFrame of term structs named like the variables
    service: Callable[[str, str, list[str]], DataFrame] | None = None
    base: str = ""

    @property
    def spark(self) -> SparkSession:
        return self.dataset.spark

    # expressions
    def evaluator(self, rel: Relation, ctx: Context, exists: dict[int, str] | None = None) -> Evaluator:
        return Evaluator(rel.lookup, lambda e: F.col(exists[id(e)]), self.base, self.functions)

    def flagged(self, rel: Relation, e: tuple | list, ctx: Context) -> tuple[Relation, dict[int, str]]:
        """``rel`` with a boolean column for each EXISTS inside ``e``."""
        flags: dict[int, str] = {}
        found: list[tuple] = []

        def walk(x):
            if isinstance(x, tuple) and x and x[0] == "exists":
                found.append(x)
            elif isinstance(x, (tuple, list)):
                for y in x:
                    walk(y)

        walk(e)
        for x in found:
            either = []
            for inner, condition, single in self.branches(x[2], rel, ctx):
                rel, flag = self.flag(rel, inner, condition, single)
                either.append(flag)
            if len(either) > 1:
                flag = fresh("flag")
                rel = Relation(rel.df.withColumn(flag, reduce(Column.__or__, map(F.col, either))), rel.slots)
            flags[id(x)] = flag
        return rel, flags

    def flag(self, rel: Relation, inner: Relation, condition: Callable[[Relation], Column] | None, single: bool) -> tuple[Relation, str]:
        """``rel`` with a boolean column: whether a row has a compatible inner row that passes."""
        uid, flag = fresh("uid"), fresh("flag")
        # rows are told apart by what they bind: the flag joins back on the shared variables alone
        names = [n for n in rel.slots if n in inner.slots]
        sure = not any(rel.slots[n].maybe or inner.slots[n].maybe for n in names)
        if sure and (single or condition is None and names):
            if condition is None:
                keys = inner.only(names)
                mark = f"_:{flag}"
                inner = Relation(keys.df.distinct().withColumn(flag, F.lit(True)), keys.slots | {mark: Slot(flag, "bool")})
                condition = lambda view: view.lookup(mark).col.isNotNull()
            merged = left_join(rel, inner)
            out = merged.df.withColumn(flag + "x", F.coalesce(condition(merged), F.lit(False)))
            return Relation(out, {n: replace(merged.slots[n], maybe=s.maybe) for n, s in rel.slots.items()}), flag + "x"
        base = Relation(rel.df.withColumn(uid, F.monotonically_increasing_id()), rel.slots)
        yes = semi(base, inner, False, condition)
        no = semi(base, inner, True, condition)
        both = yes.df.withColumn(flag, F.lit(True)).unionByName(no.df.withColumn(flag, F.lit(False)))
        return Relation(both.drop(uid), rel.slots), flag

    def branches(self, pattern: Any, outer: Relation, ctx: Context) -> list[tuple[Relation, Callable[[Relation], Column] | None, bool]]:
        """An EXISTS as alternatives (see ``correlated``): the branches of a UNION where that spares joining outer bindings into them."""
        pattern = exists_pattern(pattern, set(outer.slots))
        parts = [exists_pattern(x, set(outer.slots)) for x in alternatives(pattern)]
        mentions = [frames(self.injected(x, outer)) > frames(x) for x in parts]
        if len(parts) > 1 and any(mentions):
            made = [self.correlated(x, outer, ctx) for x in parts]
            if all(single or not mention for (_, _, single), mention in zip(made, mentions)):
                return made
        return [self.correlated(pattern, outer, ctx)]

    def correlated(self, pattern: Any, outer: Relation, ctx: Context) -> tuple[Relation, Callable[[Relation], Column] | None, bool]:
        """The inner relation of an EXISTS, its outermost filter where that alone mentions outer variables, and whether the relation has one row for each binding of the shared variables.

        Deeper mentions get the distinct outer bindings joined in where they are evaluated.
        """
        if isinstance(pattern, A.Filter) and not _has_exists(pattern.condition):
            inner = {v.name for v in A.pattern_vars(pattern.pattern)}
            if any(n in outer.slots and n not in inner for n in A.expr_vars(pattern.condition)):
                rel = self.pattern(self.injected(pattern.pattern, outer), ctx)
                few = self.witnesses(rel, pattern.condition, outer, ctx)
                if few is not None:
                    return *few, True
                return rel, lambda view: self.evaluator(view, ctx).test(pattern.condition), False
        return self.pattern(self.injected(pattern, outer), ctx), None, False

    def witnesses(self, rel: Relation, condition: tuple, outer: Relation, ctx: Context) -> tuple[Relation, Callable[[Relation], Column]] | None:
        """``rel`` as one row for each binding of the shared variables, where one comparison alone connects it with outer values.

        If any row passes ``a < outer``, the one with the least a does; so no outer row meets more than one row. None: not of this form.
        """
        own = {n for n in rel.slots if n not in outer.slots}
        early, late, mixed = [], [], []
        for c in _conjuncts(condition):
            names = A.expr_vars(c)
            if not names & own:
                late.append(c)
            else:
                (early if names <= own else mixed).append(c)
        found = extreme(mixed[0], own) if len(mixed) == 1 else None
        if found is None:
            return None
        part, largest, alone = found
        for c in early:
            rel = rel.filter(self.evaluator(rel, ctx).test(c))
        v = self.evaluator(rel, ctx).value(part)
        if v.kind not in (("int", "dec", "dbl", "dt", "date") if alone else ("dbl",)):
            return None  # whole numbers and decimals overflow in sums
        choices = [v.col]
        if not alone:  # sums with infinite values needn't rise: these are tried by themselves
            inf = F.lit(float("inf"))
            odd = [F.isnan(v.col), v.col == inf, v.col == -inf]
            choices = [F.when(~(odd[0] | odd[1] | odd[2]), v.col)] + [F.when(x, v.col) for x in odd]
        shared = [n for n in rel.slots if n not in own]
        keys = rel.only(shared)
        by = [rel.slots[n].value().col.alias(keys.slots[n].column) for n in shared]
        names = [fresh("_:w") for _ in choices]
        columns = [fresh() for _ in choices]
        aggregates = [(F.max if largest else F.min)(x).alias(c) for x, c in zip(choices, columns)]
        df = rel.df.filter(v.col.isNotNull()).groupBy(*by).agg(*aggregates)
        tests = [with_part(mixed[0], part, ("var", n)) for n in names]

        def passes(view: Relation) -> Column:
            ev = self.evaluator(view, ctx)
            out = reduce(Column.__or__, [F.coalesce(ev.test(t), F.lit(False)) for t in tests])
            return reduce(Column.__and__, [F.coalesce(ev.test(c), F.lit(False)) for c in late], out)

        return Relation(df, keys.slots | {n: Slot(c, v.kind, True) for n, c in zip(names, columns)}), passes

    def injected(self, p: Any, outer: Relation) -> Any:
        """``p`` with the distinct bindings of ``outer`` joined to each group whose expressions mention outer variables that it doesn't bind.

        The variables that the group shares with ``outer`` come along, so the join is on them where there are any.
        """

        def bound(x: Any, e: tuple) -> Any:
            own = {v.name for v in A.pattern_vars(x)}
            needed = [n for n in outer.slots if n in A.expr_vars(e) and n not in own]
            if not needed:
                return x
            frame = outer.only([n for n in outer.slots if n in needed or n in own])
            return A.Join(A.Frame(Relation(frame.df.distinct(), frame.slots)), x)

        def walk(x: Any) -> Any:
            if isinstance(x, (A.Join, A.Union, A.Lateral)):
                return replace(x, left=walk(x.left), right=walk(x.right))
            if isinstance(x, A.LeftJoin):
                left, right = walk(x.left), walk(x.right)
                if x.condition is not None:
                    both = {v.name for v in A.pattern_vars(right)}
                    left = left if A.expr_vars(x.condition) <= both else bound(left, ("op", "&&", [("var", n) for n in A.expr_vars(x.condition) - both]))
                return replace(x, left=left, right=right)
            if isinstance(x, (A.Minus, A.SemiJoin)):
                return replace(x, left=walk(x.left))
            if isinstance(x, A.Graph):
                return replace(x, pattern=walk(x.pattern))
            if isinstance(x, A.Filter):
                return replace(x, pattern=bound(walk(x.pattern), x.condition))
            if isinstance(x, A.Extend):
                return replace(x, pattern=bound(walk(x.pattern), x.expr))
            return x

        return walk(p)

    # patterns
    def pattern(self, p: Any, ctx: Context) -> Relation:
        return getattr(self, f"p_{type(p).__name__.lower()}")(p, ctx)

    def p_empty(self, p, ctx):
        return Relation.unit(self.spark)

    def p_frame(self, p: A.Frame, ctx):
        return p.relation

    def p_bgp(self, p: A.Bgp, ctx: Context) -> Relation:
        plain = [t for t in p.triples if not _is_path(t.p)]
        rest = [t for t in p.triples if _is_path(t.p)]
        parts = self.stars(plain, ctx)
        for t in rest:
            parts.append(self.path(t.s, t.p, t.o, ctx))
        out = None
        for r in self.connected(parts):
            out = r if out is None else join(out, r)
        out = out or Relation.unit(self.spark)
        # blank nodes of the pattern stay joined inside the group: they are dropped by projection
        return out

    @staticmethod
    def connected(parts: list[Relation]) -> list[Relation]:
        """An order in which each part shares a variable with those before it, if there is one."""
        left, out, seen = list(parts), [], set()
        while left:
            i = next((i for i, r in enumerate(left) if seen & set(r.slots)), 0)
            r = left.pop(i)
            out.append(r)
            seen |= set(r.slots)
        return out

    def stars(self, triples: list[A.Triple], ctx: Context) -> list[Relation]:
        if isinstance(self.dataset, MappedDataset) and ctx.graph is None and not ctx.default:
            groups: dict[Any, list[A.Triple]] = {}
            for t in triples:
                groups.setdefault(t.s, []).append(t)
            out = []
            for s, ts in groups.items():
                fixed = all(isinstance(t.p, Iri) for t in ts) and not any(isinstance(t.p, Iri) and t.p.value == T.RDF_TYPE and isinstance(t.o, Var) for t in ts)
                out += [self.star(s, ts)] if fixed else [self.scan(t, ctx) for t in ts]
            return out
        # the most constants first: the joins begin with what scans filter most
        return [self.scan(t, ctx) for t in sorted(triples, key=lambda t: -sum(not isinstance(x, Var) for x in (t.s, t.p, t.o, t.o)))]

    def star(self, s: Any, triples: list[A.Triple]) -> Relation:
        """All triples of one subject from one scan of each table that has them."""
        d: MappedDataset = self.dataset
        tables = set(d.tables)
        for t in triples:
            if t.p.value == T.RDF_TYPE:
                tables &= {d.by_class[t.o.value]} if isinstance(t.o, Iri) and t.o.value in d.by_class else set()
            else:
                tables &= {place[0] for place in d.by_property.get(t.p.value, [])}
        out = None
        for name in sorted(tables):
            one = self.table_star(name, s, triples)
            out = one if out is None else union(out, one)
        if out is None:
            df = self.spark.range(0)
            names = {x.name: Value("node", F.lit(None).cast("string"), maybe=False) for t in triples for x in (t.s, t.o) if isinstance(x, Var)}
            return Relation.select(df, names)
        return out

    def table_star(self, name: str, s: Any, triples: list[A.Triple]) -> Relation:
        d: MappedDataset = self.dataset
        table = d.tables[name]
        df, bound = table.df, {}
        conditions: list[Column] = []
        subject = d.subject(name)
        if isinstance(s, Var):
            bound[s.name] = subject
        elif isinstance(s, Iri):
            key = d.parse_key(name, s.value)
            conditions.append(F.col(table.key) == key if key is not None else F.lit(False))
        else:
            conditions.append(F.lit(False))
        for t in triples:
            if t.p.value == T.RDF_TYPE:
                continue
            _, column, ref = next(x for x in d.by_property[t.p.value] if x[0] == name)
            v = d.value(name, column, ref)
            conditions.append(F.col(column).isNotNull())
            if isinstance(t.o, Var):
                if t.o.name in bound:
                    conditions.append(same_term(bound[t.o.name], v))
                bound.setdefault(t.o.name, replace(v, maybe=False))
            elif ref:
                key = d.parse_key(ref, t.o.value) if isinstance(t.o, Iri) else None
                conditions.append(F.col(column) == key if key is not None else F.lit(False))
            else:
                conditions.append(F.coalesce(same_term(v, literal(t.o)), F.lit(False)) if not isinstance(t.o, Iri) else F.lit(False))
        for c in conditions:
            df = df.filter(c)
        return Relation.select(df, bound)

    def quads(self, ctx: Context) -> tuple[DataFrame, bool]:
        """(g, s, p, o) of the active graph, and whether g binds the graph variable."""
        quads = self.dataset.quads if isinstance(self.dataset, QuadDataset) else self.dataset.quads_frame()
        if ctx.graph is None:
            if ctx.default is None:
                return quads.filter("g is null"), False
            return quads.filter(F.col("g").isin(list(ctx.default))).dropDuplicates(["s", "p", "o"]), False
        if isinstance(ctx.graph, Iri):
            allowed = ctx.named is None or ctx.graph.value in ctx.named
            return quads.filter((F.col("g") == ctx.graph.value) & F.lit(allowed)), False
        named = quads.filter("g is not null")
        return (named if ctx.named is None else named.filter(F.col("g").isin(list(ctx.named)))), True

    def scan(self, t: A.Triple, ctx: Context) -> Relation:
        df, by_graph = self.quads(ctx)
        bound: dict[str, Value] = {}
        cells = [(t.s, Value("node", F.col("s"), maybe=False)), (t.p, Value("node", F.col("p"), maybe=False)), (t.o, Value("term", F.col("o"), maybe=False))]
        if by_graph:
            cells.append((ctx.graph, Value("node", F.col("g"), maybe=False)))
        for x, v in cells:
            if isinstance(x, Var):
                if x.name in bound:
                    df = df.filter(same_term(bound[x.name], v))
                else:
                    bound[x.name] = v
            elif v.kind == "node":
                df = df.filter(v.col == T.node_string(x)) if not isinstance(x, T.Literal) else df.filter(F.lit(False))
            else:
                k, val, dt, lang = T.term_tuple(x)
                # separate comparisons can be pushed into the scan
                df = df.filter((F.col("o.k") == k) & (F.col("o.v") == (val if k != T.BNODE_KIND else T.node_string(x))))
                if k == T.LITERAL_KIND:
                    df = df.filter((F.col("o.dt") == dt) & F.col("o.lang").eqNullSafe(F.lit(lang)))
        return Relation.select(df, bound)

    # paths
    def path(self, s: Any, p: Any, o: Any, ctx: Context) -> Relation:
        if isinstance(p, (A.Link, Iri)):
            iri = p.iri if isinstance(p, A.Link) else p.value
            return self.p_bgp(A.Bgp([A.Triple(s, Iri(iri), o)]), ctx)
        if isinstance(p, A.Inverse):
            return self.path(o, p.path, s, ctx)
        if isinstance(p, A.Seq):
            out, at, hidden = None, s, []
            for i, part in enumerate(p.parts):
                to = o if i + 1 == len(p.parts) else Var(fresh("_:p"))
                hidden.append(to)
                step = self.path(at, part, to, ctx)
                out = step if out is None else join(out, step)
                at = to
            drop = {v.name for v in hidden[:-1]}
            return out.only([n for n in out.slots if n not in drop])
        if isinstance(p, A.Alt):
            out = self.path(s, p.parts[0], o, ctx)
            for part in p.parts[1:]:
                out = union(out, self.path(s, part, o, ctx))
            return out
        if isinstance(p, A.Negated):
            return self.negated(s, p, o, ctx)
        return self.repeat(s, p, o, ctx)

    def negated(self, s, p: A.Negated, o, ctx: Context) -> Relation:
        hidden = Var(fresh("_:n"))
        out = None
        if p.has_forward:
            one = self.scan(A.Triple(s, hidden, o), ctx)
            out = one.filter(~one.lookup(hidden.name).col.isin(list(p.forward)) if p.forward else F.lit(True))
            out = out.only([n for n in out.slots if n != hidden.name])
        if p.backward is not None:
            one = self.scan(A.Triple(o, hidden, s), ctx)
            one = one.filter(~one.lookup(hidden.name).col.isin(list(p.backward)))
            one = one.only([n for n in one.slots if n != hidden.name])
            out = one if out is None else union(out, one)
        return out

    def repeat(self, s, p: A.Repeat, o, ctx: Context) -> Relation:
        x, y, g = Var(fresh("_:x")), Var(fresh("_:y")), ctx.graph
        if isinstance(g, Var):
            raise Unsupported("a repeated path inside GRAPH with a variable")
        edges = self.path(x, p.path, y, ctx)
        a, b = edges.lookup(x.name), edges.lookup(y.name)
        native = a.kind == b.kind == "key" and a.table == b.table or a.kind == b.kind and a.kind in ("int", "str", "node")
        if native and a.kind == "key" and any(not isinstance(t, Var) and not (isinstance(t, Iri) and self.dataset.parse_key(a.table, t.value) is not None) for t in (s, o)):
            native = False  # an end outside the table has no key, and still matches itself
        get = (lambda v: v.col) if native else term
        shape = replace(a, maybe=False) if native else Value("term", F.col("x"), maybe=False)
        frame = edges.df.select(get(a).alias("x"), get(b).alias("y"))

        def constant(t) -> Column | None:
            if isinstance(t, Var):
                return None
            if native and a.kind == "key":
                key = self.dataset.parse_key(a.table, t.value) if isinstance(t, Iri) else None
                return key if key is not None else F.lit(None).cast("long")
            v = literal(t)
            if native:
                return v.col if v.kind == a.kind else F.lit(None)
            return term(v)

        cs, co = constant(s), constant(o)
        if p.most is not None and (p.counting or p.most > 1):
            zero = self.zero_pairs(frame, a.table if native else None, native, cs, co, ctx) if p.least == 0 else None
            pairs = paths.bounded(frame, p.least, p.most, zero)
        elif p.most is not None:  # p?
            pairs = frame.union(self.zero_pairs(frame, a.table if native else None, native, cs, co, ctx)).distinct()
        else:
            if cs is not None:
                pairs = paths.reachable(frame, self.spark.range(1).select(cs.alias("x")))
            elif co is not None:
                pairs = paths.reachable(frame.select("y", "x"), self.spark.range(1).select(co.alias("x"))).toDF("y", "x").select("x", "y")
            else:
                pairs = paths.closure(frame)
            if p.least == 0:
                pairs = pairs.union(self.zero_pairs(frame, a.table if native else None, native, cs, co, ctx)).distinct()
            elif p.least > 1:
                pairs = paths.bounded(frame, p.least, p.least, None).toDF("x", "m").join(pairs.toDF("m", "y").union(frame.select(F.col("x").alias("m"), F.col("x").alias("y")).distinct()), "m").select("x", "y").distinct()
        rel = Relation.select(pairs, {x.name: shape.with_col(F.col("x")), y.name: shape.with_col(F.col("y"))})
        for t, v, c in ((s, x, cs), (o, y, co)):
            if c is not None:
                rel = rel.filter(rel.lookup(v.name).col == c)
        names = {}
        for t, v in ((s, x), (o, y)):
            if isinstance(t, Var):
                if t.name in names:
                    rel = rel.filter(rel.lookup(v.name).col == names[t.name].col)
                else:
                    names[t.name] = rel.lookup(v.name)
        return Relation.select(rel.df, names)

    def zero_pairs(self, frame: DataFrame, table: str | None, native: bool, cs, co, ctx: Context) -> DataFrame:
        """(x, x) of every node of the graph, and of constant ends."""
        if cs is not None or co is not None:
            return self.spark.range(1).select((cs if cs is not None else co).alias("x"), (cs if cs is not None else co).alias("y"))
        if native:
            # in a mapped key space the nodes are the rows of the table, and what its references name besides
            nodes = frame.select("x").union(frame.select("y"))
            if table is not None:
                place = self.dataset.tables[table]
                nodes = nodes.union(place.df.select(F.col(place.key).cast(frame.schema["x"].dataType).alias("x")))
            nodes = nodes.filter("x is not null").distinct()
            return nodes.select("x", F.col("x").alias("y"))
        quads, _ = self.quads(ctx)
        nodes = quads.select(term(Value("node", F.col("s"))).alias("x")).union(quads.select(F.col("o").alias("x"))).distinct()
        return nodes.select("x", F.col("x").alias("y"))

    # operators
    def p_join(self, p: A.Join, ctx):
        return join(self.pattern(p.left, ctx), self.pattern(p.right, ctx))

    def p_leftjoin(self, p: A.LeftJoin, ctx):
        left, right = self.pattern(p.left, ctx), self.pattern(p.right, ctx)
        if p.condition is None:
            return left_join(left, right)
        if _has_exists(p.condition):
            right, flags = self.flagged(right, p.condition, ctx)
            slots = {f"_:{c}": Slot(c, "bool") for c in flags.values()}
            right = Relation(right.df, right.slots | slots)

            def on(view):
                names = {i: view.lookup(f"_:{c}").col for i, c in flags.items()}
                return Evaluator(view.lookup, lambda e: names[id(e)], self.base, self.functions).test(p.condition)

            out = left_join(left, right, on)
            return out.only([n for n in out.slots if n not in slots])
        return left_join(left, right, lambda view: self.evaluator(view, ctx).test(p.condition))

    def p_union(self, p: A.Union, ctx):
        return union(self.pattern(p.left, ctx), self.pattern(p.right, ctx))

    def p_minus(self, p: A.Minus, ctx):
        return minus(self.pattern(p.left, ctx), self.pattern(p.right, ctx))

    def p_semijoin(self, p: A.SemiJoin, ctx):
        return semi(self.pattern(p.left, ctx), self.pattern(p.right, ctx), p.anti)

    def p_graph(self, p: A.Graph, ctx):
        inner = replace(ctx, graph=p.name)
        out = self.pattern(p.pattern, inner)
        if isinstance(p.name, Var) and p.name.name not in out.slots:
            quads, _ = self.quads(inner)
            out = join(out, Relation.select(quads.select("g").distinct(), {p.name.name: Value("node", F.col("g"), maybe=False)}))
        return out

    def p_extend(self, p: A.Extend, ctx):
        rel, flags = self.flagged(self.pattern(p.pattern, ctx), p.expr, ctx)
        return rel.add(p.var.name, self.evaluator(rel, ctx, flags).value(p.expr))

    def banded(self, p: A.Filter, ctx: Context) -> Relation | None:
        """The pattern of a filter that keeps a value of one unconnected part between two of the other, joined by ranges of that value; None: not of this form."""
        inside = p.pattern
        if isinstance(inside, A.Bgp):
            groups = _connected(inside.triples)
            if len(groups) != 2:
                return None
            sides = [A.Bgp(g) for g in groups]
        elif isinstance(inside, A.Join):
            sides = [inside.left, inside.right]
        else:
            return None
        names = [{v.name for v in A.pattern_vars(x)} for x in sides]
        if names[0] & names[1]:
            return None
        for i, j in ((0, 1), (1, 0)):
            found = band(_conjuncts(p.condition), names[i], names[j])
            if found is None:
                continue
            left, right = self.pattern(sides[i], ctx), self.pattern(sides[j], ctx).renamed()
            low, high, value = (self.evaluator(r, ctx).value(e) for r, e in ((left, found[0]), (left, found[1]), (right, found[2])))
            if set(left.slots) & set(right.slots) or any(v.kind not in NUMBERS for v in (low, high, value)):
                return join(left, right)
            return band_join(left, right, low.col, high.col, value.col, found[3])
        return None

    def p_filter(self, p: A.Filter, ctx):
        rel = self.banded(p, ctx)
        rel = self.pattern(p.pattern, ctx) if rel is None else rel
        rest = []
        for c in _conjuncts(p.condition):
            negated = c[0] == "op" and c[1] == "!" and c[2][0][0] == "exists"
            if c[0] == "exists" or negated:
                e = c[2][0] if negated else c
                found = self.branches(e[2], rel, ctx)
                if len(found) == 1 or e[1] != negated:
                    for inner, condition, _ in found:
                        rel = semi(rel, inner, e[1] != negated, condition)
                    continue
                either = []
                for inner, condition, single in found:
                    rel, flag = self.flag(rel, inner, condition, single)
                    either.append(F.col(flag))
                rel = rel.filter(reduce(Column.__or__, either))
            else:
                rest.append(c)
        for c in rest:
            rel, flags = self.flagged(rel, c, ctx)
            rel = rel.filter(self.evaluator(rel, ctx, flags).test(c))
        return rel

    def p_values(self, p: A.Values, ctx):
        names = [v.name for v in p.vars]
        kinds: dict[str, Value] = {}
        columns = []
        for i, n in enumerate(names):
            values = [literal(r[i]) for r in p.rows if r[i] is not None]
            shapes = {v.kind for v in values}
            kinds[n] = values[0] if len(shapes) == 1 else Value("term", F.lit(None))
        if not p.rows or not names:
            df = self.spark.range(len(p.rows))
            return Relation.select(df, {n: Value("node", F.lit(None).cast("string")) for n in names})
        rows = []
        for r in p.rows:
            cells = []
            for i, n in enumerate(names):
                v = literal(r[i]) if r[i] is not None else None
                c = None if v is None else term(v) if kinds[n].kind == "term" else v.col
                cells.append(F.lit(None) if c is None else c)
            rows.append(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cells)]))
        # types of nulls come from the rows that have a value
        full = [i for i in range(len(names))]
        casts = {i: _kind_type(kinds[names[i]].kind) for i in full}
        rows = [F.struct(*[r[f"c{i}"].cast(casts[i]).alias(f"c{i}") for i in full]) for r in rows]
        df = self.spark.range(1).select(F.inline(F.array(*rows)))
        values = {n: Value(kinds[n].kind, F.col(f"c{i}"), maybe=any(r[i] is None for r in p.rows)) for i, n in enumerate(names)}
        return Relation.select(df, values)

    def p_subquery(self, p: A.SubQuery, ctx):
        return self.solutions(p.query, ctx)

    def p_lateral(self, p: A.Lateral, ctx):
        """The right side sees the left row.

        A sub-select with LIMIT is a top-k by the shared variables, one with aggregates is
        grouped by them; expressions that mention left variables get the left bindings.
        """
        left = self.pattern(p.left, ctx)
        if isinstance(p.right, A.SubQuery):
            q = p.right.query
            names = [n for n in left.slots if n in {v.name for v in A.pattern_vars(q.where)}]
            if (q.limit is not None or q.offset) and q.group is None and not _aggregates(q):
                inner = self.pattern(q.where, ctx)
                for v, e in q.select or []:
                    if e is not None:
                        inner = inner.add(v.name, self.evaluator(inner, ctx).value(e))
                from pyspark.sql import Window

                by = [c for n in names for c in sort_keys(inner.lookup(n))]
                window = Window.partitionBy(*by).orderBy(*(self.order_by(inner, q.order, ctx) or [F.lit(1)]))
                rank = fresh("rank")
                top = inner.df.withColumn(rank, F.row_number().over(window)).filter((F.col(rank) > q.offset) & (F.col(rank) <= q.offset + (q.limit if q.limit is not None else 2**31 - 1)))
                keep = [v.name for v, _ in q.select] if q.select is not None else list(inner.slots)
                return join(left, Relation(top, inner.slots).only(list(dict.fromkeys([*names, *keep]))))
            if q.group is not None or _aggregates(q):
                return self.lateral_groups(left, q, names, ctx)
        if isinstance(p.right, (A.Extend, A.Filter)) and isinstance(p.right.pattern, A.Empty):
            moved = replace(p.right, pattern=A.Empty())
            rel, flags = self.flagged(left, moved.expr if isinstance(moved, A.Extend) else moved.condition, ctx)
            ev = self.evaluator(rel, ctx, flags)
            return rel.add(moved.var.name, ev.value(moved.expr)) if isinstance(moved, A.Extend) else rel.filter(ev.test(moved.condition))
        return join(left, self.pattern(self.injected(p.right, left), ctx))

    def lateral_groups(self, left: Relation, q: A.Query, names: list[str], ctx: Context) -> Relation:
        """Aggregates of the right side for each left row: groups by the shared variables; left rows without a solution get the empty group."""
        if q.limit is not None or q.offset or q.select is None:
            raise Unsupported("LATERAL with aggregates and a slice")
        if any(left.slots[n].maybe for n in names):
            raise Unsupported("LATERAL with aggregates over variables that may be unbound")
        chosen = {v.name for v, _ in q.select}
        by = [(Var(n), None) for n in names]
        inner = self.injected(q.where, left)
        each = replace(q, where=inner, group=[*by, *[(v, e) for v, e in q.group or [] if v.name not in names]], select=[*[(v, e) for v, e in by if v.name not in chosen], *q.select], order=[])
        out = join(left, self.solutions(each, ctx))
        if q.group:
            return out
        # no solution at all: the aggregates of nothing
        some = self.solutions(replace(each, having=[], select=by), ctx)
        none = join(semi(left, some, True), self.solutions(replace(q, where=A.Filter(("term", T.Literal("false", T.XSD + "boolean")), q.where), order=[]), ctx).only([n for n in chosen if n not in names]))
        return union(out, none)

    def p_service(self, p: A.Service, ctx):
        names = [v.name for v in A.pattern_vars(p.pattern)]
        try:
            if self.service is None or not isinstance(p.name, Iri):
                raise Unsupported("no SERVICE client is configured")
            df = self.service(p.name.value, p.text, names)
            return Relation.select(df, {n: Value("term", F.col(n)) for n in names})
        except Exception:
            if p.silent:
                return Relation.unit(self.spark)
            raise

    # query level
    def order_by(self, rel: Relation, order: list[tuple[bool, tuple]], ctx: Context, flags=None) -> list[Column]:
        out = []
        for down, e in order:
            for c in sort_keys(self.evaluator(rel, ctx, flags).value(e)):
                out.append(c.desc_nulls_last() if down else c.asc_nulls_first())
        return out

    def solutions(self, q: A.Query, ctx: Context) -> Relation:
        """Solutions of a SELECT (or of the WHERE of another form), with modifiers."""
        if q.graphs or q.named:
            ctx = Context(None, tuple(q.graphs), tuple(q.named))
        rel = self.pattern(q.where, ctx) if q.where is not None else Relation.unit(self.spark)
        select = q.select
        order = q.order
        if q.group is not None or _aggregates(q):
            rel, select, having, order = self.grouped(rel, q, ctx)
            for h in having:
                rel, flags = self.flagged(rel, h, ctx)
                rel = rel.filter(self.evaluator(rel, ctx, flags).test(h))
        if select is not None:
            for v, e in select:
                if e is not None:
                    rel, flags = self.flagged(rel, e, ctx)
                    rel = rel.add(v.name, self.evaluator(rel, ctx, flags).value(e))
            names = [v.name for v, _ in select]
        else:
            names = [n for n in rel.slots if not n.startswith("_:")]
        if q.values is not None:
            rel = join(rel, self.p_values(q.values, ctx))
            names += [v.name for v in q.values.vars if q.select is None and v.name not in names]
        keys = self.order_by(rel, order, ctx)
        if q.distinct:
            rel = Relation(rel.only(names).df.distinct(), {}) if not names else _distinct(rel, names)
            keys = self.order_by(rel, order, ctx)
        if keys:
            rel = Relation(rel.df.orderBy(*keys), rel.slots)
        if q.offset:
            rel = Relation(rel.df.offset(q.offset), rel.slots)
        if q.limit is not None:
            rel = Relation(rel.df.limit(q.limit), rel.slots)
        out = rel.only(names)
        for n in names:
            if n not in out.slots:  # projected but never bound
                out = out.add(n, Value("node", F.lit(None).cast("string")))
        return out

    def grouped(self, rel: Relation, q: A.Query, ctx: Context):
        keys: dict[str, Value] = {}
        for v, e in q.group or []:
            if e is not None:
                rel = rel.add(v.name, self.evaluator(rel, ctx).value(e))
            value = rel.lookup(v.name)
            if value is not None:
                keys[v.name] = value
        found: list[tuple[tuple, str]] = []

        def replace_aggs(e):
            if isinstance(e, tuple) and e and e[0] == "agg":
                for known, name in found:
                    if known == e:
                        return ("var", name)
                found.append((e, fresh("_:a")))
                return ("var", found[-1][1])
            if isinstance(e, tuple) and e and e[0] in ("op", "call"):
                return (e[0], e[1], [replace_aggs(x) for x in e[2]])
            return e

        select = None if q.select is None else [(v, e if e is None else replace_aggs(e)) for v, e in q.select]
        having = [replace_aggs(h) for h in q.having]
        order = [(d, replace_aggs(e)) for d, e in q.order]
        ev = self.evaluator(rel, ctx)
        row = F.struct(*[F.col(s.column) for n, s in rel.slots.items() if not n.startswith("_:")]) if rel.slots else F.lit(1)
        aggs, shapes = [], {}
        for e, name in found:
            v = None if e[3] is None else ev.value(e[3])
            c, shape = aggregate(e[1], e[2], v, e[4], row)
            out = fresh()
            aggs.append(c.alias(out))
            shapes[name] = (out, shape)
        columns, slots = [], {}
        for n, v in keys.items():
            c = fresh()
            columns.append(v.col.alias(c))
            slots[n] = Slot(c, v.kind, v.maybe, v.prefix, v.table)
        grouped = rel.df.groupBy(*columns) if columns else rel.df.groupBy()
        df = grouped.agg(*aggs) if aggs else rel.df.select(*columns).distinct()
        for name, (c, shape) in shapes.items():
            slots[name] = Slot(c, shape.kind, True, shape.prefix, shape.table)
        return Relation(df, slots), select, having, order


def _distinct(rel: Relation, names: list[str]) -> Relation:
    out = rel.only(names)
    return Relation(out.df.distinct(), out.slots)


def _kind_type(kind: str) -> str:
    return {"node": "string", "str": "string", "int": "bigint", "dec": "decimal(38,18)", "dbl": "double", "bool": "boolean", "dt": "timestamp_ntz", "date": "date", "term": T.TERM_TYPE}[kind]


def _connected(triples: list[A.Triple]) -> list[list[A.Triple]]:
    """Triples in groups without a common variable."""
    groups: list[tuple[set[str], list[A.Triple]]] = []
    for t in triples:
        names = {x.name for x in (t.s, t.p, t.o) if isinstance(x, Var)}
        met = [g for g in groups if g[0] & names]
        groups = [g for g in groups if not g[0] & names] + [(names.union(*(g[0] for g in met)), [x for g in met for x in g[1]] + [t])]
    return [g[1] for g in groups]


def _is_path(p: Any) -> bool:
    return not isinstance(p, (Var, Iri))


def _has_agg(e: Any) -> bool:
    if isinstance(e, tuple) and e and e[0] == "agg":
        return True
    return isinstance(e, (tuple, list)) and any(_has_agg(x) for x in e)


def _aggregates(q: A.Query) -> bool:
    return any(_has_agg(e) for _, e in q.select or []) or any(map(_has_agg, q.having)) or any(_has_agg(e) for _, e in q.order)


def to_frame(rel: Relation, names: list[str] | None = None) -> DataFrame:
    """Columns named after the variables: native values, IRI strings, or term structs where the kind varies."""
    names = names if names is not None else [n for n in rel.slots if not n.startswith("_:")]
    columns = []
    for n in names:
        v = rel.lookup(n)
        columns.append((lexical(v) if v.kind in ("key", "node") else v.col).alias(n))
    return rel.df.select(*columns) if columns else rel.df.select()


def plain(df: DataFrame) -> DataFrame:
    """Term structs as their lexical form."""
    return df.select(*[F.col(c)["v"].alias(c) if kind.startswith("struct<k:") else F.col(c) for c, kind in df.dtypes])


__all__ = ["Compiler", "Context", "Unsupported", "ebv", "equal", "node", "parse_query", "plain", "to_frame"]
