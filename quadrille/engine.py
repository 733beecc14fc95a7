"""The query interface: SELECT, ASK, CONSTRUCT, DESCRIBE and updates over a dataset."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import terms as T
from .dataset import MappedDataset, QuadDataset
from .functions.values import Value, node, term
from .operators.relation import Relation
from .plans import algebra as A
from .plans.compiler import Compiler, Context, to_frame
from .plans.parser import parse, parse_query, parse_update
from .session import staged
from .terms import Iri, Var


def query(dataset: QuadDataset | MappedDataset, text: str | A.Query, **options) -> DataFrame:
    """SELECT: one column a variable. ASK: one row ``ask``. CONSTRUCT and DESCRIBE: distinct (s, p, o)."""
    q = parse_query(text, dataset.prefixes) if isinstance(text, str) else text
    c = Compiler(dataset, **options)
    ctx = Context()
    if q.form == "SELECT":
        rel = c.solutions(q, ctx)
        names = [v.name for v, _ in q.select] if q.select is not None else None
        return to_frame(rel, names)
    if q.form == "ASK":
        rel = c.solutions(replace(q, select=None, limit=1), ctx)
        return rel.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
    if q.form == "CONSTRUCT":
        quads = construct(c.solutions(replace(q, select=None, order=q.order), ctx), q.template)
        return quads.select("s", "p", "o").distinct()
    return describe(c, q, ctx)


def ask(dataset: QuadDataset | MappedDataset, text: str, **options) -> bool:
    return query(dataset, text, **options).first()["ask"]


def _cell(rel: Relation, x, blank: Column) -> tuple[Column, Column]:
    """(node string, term struct) of a template position; blank nodes are fresh for each solution."""
    if isinstance(x, Var) and x.name.startswith("_:"):
        s = F.concat(F.lit(f"_:{x.name[2:]}-"), blank)
        return s, term(Value("node", s))
    if isinstance(x, Var):
        v = rel.lookup(x.name)
        return (F.lit(None).cast("string"), F.lit(None).cast(T.TERM_TYPE)) if v is None else (node(v), term(v))
    if isinstance(x, T.Literal):
        from .functions.values import term_literal

        return F.lit(None).cast("string"), term_literal(x)
    return F.lit(T.node_string(x)), term(Value("node", F.lit(T.node_string(x))))


def construct(rel: Relation, template: list[tuple]) -> DataFrame:
    """(g, s, p, o) of the template over all solutions in one pass; ill-formed triples are dropped."""
    # blank nodes are named by the solution's content and row
    blank = F.hex(F.monotonically_increasing_id()) if any(isinstance(x, Var) and x.name.startswith("_:") for _, t in template for x in (t.s, t.p, t.o)) else F.lit("")
    cells = []
    for g, t in template:
        s, p, o = _cell(rel, t.s, blank)[0], _cell(rel, t.p, blank)[0], _cell(rel, t.o, blank)[1]
        gs = F.lit(None).cast("string") if g is None else _cell(rel, g, blank)[0]
        missing = F.lit(False) if g is None else gs.isNull()
        ok = s.isNotNull() & p.isNotNull() & ~p.startswith("_:") & o.isNotNull() & ~missing
        cells.append(F.when(ok, F.struct(gs.alias("g"), s.alias("s"), p.alias("p"), o.alias("o"))))
    if not cells:
        return rel.spark.createDataFrame([], T.QUAD_TYPE)
    return rel.df.select(F.explode(F.array(*cells)).alias("q")).filter("q is not null").select("q.g", "q.s", "q.p", "q.o")


def describe(c: Compiler, q: A.Query, ctx: Context) -> DataFrame:
    """All triples of the resources, and of blank nodes reached from them."""
    resources = []
    if q.where is not None:
        rel = c.solutions(replace(q, select=None), ctx)
        names = [v.name for v in q.describe if isinstance(v, Var)] if q.describe is not None else [n for n in rel.slots if not n.startswith("_:")]
        resources += [rel.df.select(node(rel.lookup(n)).alias("s")) for n in names if n in rel.slots]
    fixed = [x.value for x in q.describe or [] if isinstance(x, Iri)]
    mapped = isinstance(c.dataset, MappedDataset) and not q.graphs and not q.named
    triples = None if mapped else (c.quads(ctx) if not q.graphs else c.quads(Context(None, tuple(q.graphs), tuple(q.named))))[0].select("s", "p", "o")

    def about(subjects: DataFrame) -> DataFrame:
        return c.dataset.about(subjects).select("s", "p", "o") if mapped else triples.join(subjects, "s", "left_semi")

    # staged, so that the joins know how few they are
    found = staged(reduce(DataFrame.union, resources).filter("s is not null").distinct(), "describe-resources") if resources else None
    named = c.spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in fixed])).alias("s")) if fixed else None
    parts = [] if found is None else [about(found)]
    if fixed:
        parts.append(c.dataset.about_iris(fixed).select("s", "p", "o") if mapped else triples.filter(F.col("s").isin(*fixed)))
    if not parts:
        return (c.dataset.quads_frame() if mapped else triples).select("s", "p", "o").filter(F.lit(False))
    out = staged(reduce(DataFrame.union, parts).distinct(), "describe")
    seen = reduce(DataFrame.union, [x for x in (found, named) if x is not None])
    while True:
        blank = out.filter((F.col("o.k") == T.BNODE_KIND)).select(F.col("o.v").alias("s")).distinct().join(seen, "s", "left_anti")
        blank = staged(blank, "describe-blank")
        if blank.isEmpty():
            return out
        seen = seen.union(blank)
        out = staged(out.union(about(blank)).distinct(), "describe")


# updates
def update(dataset: QuadDataset, text: str | list[A.Update], load: Callable[[str], QuadDataset] | None = None, **options) -> QuadDataset:
    """The dataset after the update; the given one stays as it was. LOAD needs ``load``, a function from IRI to dataset."""
    ups = parse_update(text, dataset.prefixes) if isinstance(text, str) else text
    for u in ups:
        dataset = _apply(dataset, u, load, options)
    return dataset


def _data(spark, quads: list[tuple], g: str | None = None) -> DataFrame:
    def fixed(x):
        return T.BNode(x.name) if isinstance(x, Var) else x

    rows = [(Iri(g) if graph is None and g else graph, fixed(t.s), fixed(t.p), fixed(t.o)) for graph, t in quads]
    return QuadDataset.of(spark, rows).quads


def _remove(quads: DataFrame, gone: DataFrame) -> DataFrame:
    a, b = quads.select("g", "s", "p", "o"), gone.select("g", "s", "p", "o").distinct().toDF("g2", "s2", "p2", "o2")
    return a.join(b, a["g"].eqNullSafe(b["g2"]) & (a["s"] == b["s2"]) & (a["p"] == b["p2"]) & (a["o"] == b["o2"]), "left_anti")


def _add(quads: DataFrame, more: DataFrame) -> DataFrame:
    return quads.select("g", "s", "p", "o").union(more.select("g", "s", "p", "o")).dropDuplicates(["g", "s", "p", "o"])


def _in_graph(ref: str) -> Column:
    if ref == "DEFAULT":
        return F.col("g").isNull()
    if ref == "NAMED":
        return F.col("g").isNotNull()
    return F.lit(True) if ref == "ALL" else F.col("g").eqNullSafe(ref)


def _apply(d: QuadDataset, u: A.Update, load, options) -> QuadDataset:
    if u.kind == "INSERT DATA":
        return QuadDataset(_add(d.quads, _data(d.spark, u.inserts)), d.prefixes)
    if u.kind == "DELETE DATA":
        return QuadDataset(_remove(d.quads, _data(d.spark, u.deletes)), d.prefixes)
    if u.kind in ("MODIFY", "DELETE WHERE"):
        ctx = Context()
        if u.using or u.using_named:
            ctx = Context(None, tuple(u.using), tuple(u.using_named))
        elif u.with_graph:
            ctx = Context(None, (u.with_graph,), None)
        rel = Compiler(d, **options).pattern(u.where, ctx)
        # deletes and inserts see one evaluation of the old state
        rel = Relation(staged(rel.df, "update"), rel.slots)
        target = lambda quads: [(Iri(u.with_graph) if g is None and u.with_graph else g, t) for g, t in quads]
        quads = d.quads
        if u.deletes:
            quads = _remove(quads, construct(rel, target(u.deletes)))
        if u.inserts:
            quads = _add(quads, construct(rel, target(u.inserts)))
        return QuadDataset(quads, d.prefixes)
    if u.kind == "CREATE":
        return d  # a graph exists by its triples
    if u.kind in ("CLEAR", "DROP"):
        return QuadDataset(d.quads.filter(~_in_graph(u.source)), d.prefixes)
    if u.kind == "LOAD":
        try:
            if load is None:
                raise ValueError("no loader is configured")
            more = load(u.source)
        except Exception:
            if u.silent:
                return d
            raise
        triples = more.quads.filter("g is null").select(F.lit(u.target).cast("string").alias("g"), "s", "p", "o")
        return QuadDataset(_add(d.quads, triples), d.prefixes)
    if u.source == u.target:
        return d
    name = lambda ref: F.lit(None if ref == "DEFAULT" else ref).cast("string")
    moved = d.quads.filter(_in_graph(u.source)).select(name(u.target).alias("g"), "s", "p", "o")
    quads = d.quads
    if u.kind in ("COPY", "MOVE"):
        quads = quads.filter(~_in_graph(u.target))
    if u.kind == "MOVE":
        quads = quads.filter(~_in_graph(u.source))
    return QuadDataset(_add(quads, moved), d.prefixes)


def explain(dataset: QuadDataset | MappedDataset, text: str) -> str:
    """The algebra, and the physical plan Spark makes of it."""
    q = parse(text, dataset.prefixes)
    if isinstance(q, list):
        return "\n".join(f"({u.kind.lower()}\n{A.show(u.where, 1)})" for u in q)
    df = query(dataset, q)
    return A.show(q) + "\n\n" + df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
