"""Datasets: quads in one DataFrame, and ordinary tables mapped to RDF.

Quads are rows (g, s, p, o): g null is the default graph, subjects and predicates
are strings, objects term structs. A mapped dataset never makes triples unless a
query asks for any predicate: its compiler turns all patterns on one subject into
a single scan of the table with native columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms as T
from .functions.values import Value, node, term
from .session import staged


class QuadDataset:
    """Immutable quads; every change returns a new dataset."""

    def __init__(self, quads: DataFrame, prefixes: dict[str, str] | None = None):
        self.quads, self.prefixes = quads, dict(prefixes or {})
        self.spark = quads.sparkSession

    @staticmethod
    def empty(spark: SparkSession) -> QuadDataset:
        return QuadDataset(spark.createDataFrame([], T.QUAD_TYPE))

    @staticmethod
    def of(spark: SparkSession, rows: list[tuple], prefixes: dict[str, str] | None = None) -> QuadDataset:
        """From (graph or None, subject, predicate, object) terms."""
        data = [(g and g.value, T.node_string(s), p.value, T.term_tuple(o) if not isinstance(o, T.BNode) else (T.BNODE_KIND, T.node_string(o), None, None)) for g, s, p, o in rows]
        return QuadDataset(spark.createDataFrame(data, T.QUAD_TYPE), prefixes)

    def default_graph(self) -> DataFrame:
        return self.quads.filter("g is null").select("s", "p", "o")

    def graph(self, name: str | None) -> DataFrame:
        return self.default_graph() if name is None else self.quads.filter(F.col("g") == name).select("s", "p", "o")

    def graph_names(self) -> DataFrame:
        """Distinct names of the named graphs; the default graph has none."""
        return self.quads.filter("g is not null").select("g").distinct()

    def find(self, s: T.Term | None = None, p: T.Iri | None = None, o: T.Term | None = None, g: str | None = None) -> DataFrame:
        """Triples that match; None is a wildcard."""
        from .functions.values import term_literal

        out = self.graph(g)
        if s is not None:
            out = out.filter(F.col("s") == T.node_string(s))
        if p is not None:
            out = out.filter(F.col("p") == p.value)
        return out if o is None else out.filter(F.col("o") == term_literal(o))

    def union(self, *others: QuadDataset) -> QuadDataset:
        """Graphs of one name are merged as sets."""
        quads = reduce(DataFrame.unionByName, [d.quads for d in others], self.quads).dropDuplicates(["g", "s", "p", "o"])
        return QuadDataset(quads, reduce(lambda a, d: a | d.prefixes, others, self.prefixes))

    def union_default(self) -> QuadDataset:
        """The default graph is the union of all graphs; named graphs stay addressable."""
        everything = self.quads.select(F.lit(None).cast("string").alias("g"), "s", "p", "o")
        return QuadDataset(everything.union(self.quads.filter("g is not null").select("g", "s", "p", "o")).dropDuplicates(["g", "s", "p", "o"]), self.prefixes)

    def with_graph(self, name: str | None, triples: DataFrame) -> QuadDataset:
        """The graph replaced."""
        kept = self.quads.filter("g is not null" if name is None else ~F.col("g").eqNullSafe(name)).select("g", "s", "p", "o")
        return QuadDataset(kept.union(triples.select(F.lit(name).cast("string").alias("g"), "s", "p", "o")), self.prefixes)

    def without_graph(self, name: str) -> QuadDataset:
        return QuadDataset(self.quads.filter(~F.col("g").eqNullSafe(name)), self.prefixes)

    def write(self, path: str) -> None:
        """Parquet partitioned by predicate, so that patterns with a constant predicate read its folder alone."""
        self.quads.withColumn("pred", F.col("p")).write.partitionBy("pred").mode("overwrite").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> QuadDataset:
        df = spark.read.parquet(path)
        return QuadDataset(df.select("g", "s", F.col("pred").alias("p"), "o"))

    def staged(self) -> QuadDataset:
        return QuadDataset(staged(self.quads, "quads"), self.prefixes)


KINDS = {"string": "str", "int": "int", "bigint": "int", "smallint": "int", "tinyint": "int", "double": "dbl", "float": "dbl", "boolean": "bool", "timestamp": "dt", "timestamp_ntz": "dt", "date": "date"}


@dataclass
class TableMap:
    """How one table is RDF: class, key column (None: a blank node a row), and references column -> table."""

    name: str
    df: DataFrame
    key: str | None
    refs: dict[str, str] = field(default_factory=dict)


@dataclass
class MappedDataset:
    """Direct mapping. Class ``ns + Table``, properties ``ns + column``, references ``ns + table.ref``, subjects ``base + table/key``."""

    spark: SparkSession
    tables: dict[str, TableMap]
    ns: str = "http://example.org/tpch#"
    base: str = "http://example.org/tpch/"
    prefixes: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.by_class = {self.ns + t.name.capitalize(): t.name for t in self.tables.values()}
        self.by_property: dict[str, list[tuple[str, str, str | None]]] = {}
        for t in self.tables.values():
            for c, kind in t.df.dtypes:
                if kind in KINDS or kind.startswith("decimal"):
                    self.by_property.setdefault(self.ns + c, []).append((t.name, c, None))
            for c, ref in t.refs.items():
                self.by_property.setdefault(f"{self.ns}{t.name}.{ref}", []).append((t.name, c, ref))

    def subject(self, table: str, df: DataFrame | None = None) -> Value:
        t = self.tables[table]
        if t.key:
            return Value("key", F.col(t.key), prefix=f"{self.base}{table}/", maybe=False, table=table)
        # two rows of one content would be one blank node
        return Value("key", F.xxhash64(*[F.col(c) for c in t.df.columns]), prefix=None, maybe=False, table=table)

    def value(self, table: str, column: str, ref: str | None) -> Value:
        kind = dict(self.tables[table].df.dtypes)[column]
        if ref:
            return Value("key", F.col(column), prefix=f"{self.base}{ref}/", table=ref)
        if kind.startswith("decimal"):
            return Value("dec", F.col(column).cast("decimal(38,18)"))
        c = F.col(column)
        return Value(KINDS[kind], c.cast("timestamp_ntz") if kind == "timestamp" else c.cast("long") if KINDS[kind] == "int" else c.cast("double") if kind == "float" else c)

    def parse_key(self, table: str, iri: str) -> Column | None:
        """The native key of a subject IRI of ``table``, or None."""
        t = self.tables[table]
        head = f"{self.base}{table}/"
        if not t.key or not iri.startswith(head):
            return None
        return F.lit(iri[len(head) :]).try_cast(dict(t.df.dtypes)[t.key])

    def table_quads(self, name: str, rows: DataFrame | None = None) -> DataFrame:
        """The triples of one table, or of some of its rows: one scan, exploded."""
        t = self.tables[name]
        s = node(self.subject(name))
        cells = [F.struct(F.lit(T.RDF_TYPE).alias("p"), term(Value("node", F.lit(self.ns + name.capitalize()))).alias("o"))]
        for iri, places in self.by_property.items():
            for table, column, ref in places:
                if table == name:
                    cells.append(F.struct(F.lit(iri).alias("p"), term(self.value(table, column, ref)).alias("o")))
        rows = t.df if rows is None else rows
        return rows.select(s.alias("s"), F.explode(F.array(*cells)).alias("x")).select(F.lit(None).cast("string").alias("g"), "s", "x.p", "x.o").filter("o is not null")

    def quads_frame(self) -> DataFrame:
        """All triples, made: one scan a table, exploded. For patterns without a constant predicate."""
        return reduce(DataFrame.union, map(self.table_quads, self.tables))

    def as_quads(self) -> QuadDataset:
        """The triples as a set. Only rows that share their key can repeat one, so triples of others aren't compared."""
        if any(sum(x[0] == t for x in places) > 1 for places in self.by_property.values() for t in self.tables) or sum(t.key is None for t in self.tables.values()) > 1:
            return QuadDataset(self.quads_frame().dropDuplicates(["s", "p", "o"]), self.prefixes)
        frames = []
        for name, t in self.tables.items():
            key = self.subject(name).col
            whole = t.key is None or dict(t.df.dtypes)[t.key] in ("bigint", "int", "smallint", "tinyint")
            key = key if whole else node(self.subject(name))
            often = t.df.groupBy(key.alias("_key")).count().filter("count > 1").select("_key")
            same = key.eqNullSafe(F.col("_key"))
            frames.append(self.table_quads(name, t.df.join(often, same, "left_anti")))
            frames.append(self.table_quads(name, t.df.join(often, same, "left_semi")).dropDuplicates(["s", "p", "o"]))
        return QuadDataset(reduce(DataFrame.union, frames), self.prefixes)

    def about(self, subjects: DataFrame) -> DataFrame:
        """Triples of the subjects (s): rows are chosen by subject before triples are made."""
        chosen = subjects.select(F.col("s").alias("_s"))
        return reduce(DataFrame.union, [self.table_quads(name, t.df.join(chosen, node(self.subject(name)) == F.col("_s"), "left_semi")) for name, t in self.tables.items()])

    def about_iris(self, iris: list[str]) -> DataFrame:
        """Triples of given IRIs: a pushed filter on the key of the table that an IRI names."""
        frames = []
        for name, t in self.tables.items():
            keys = [k for k in (self.parse_key(name, x) for x in iris) if k is not None]
            if keys:
                chosen = t.df.filter(F.col(t.key).isin(*keys))
                frames.append(self.table_quads(name, chosen).filter(F.col("s").isin(*iris)))
        return reduce(DataFrame.union, frames) if frames else self.quads_frame().filter(F.lit(False))


TPCH = {
    "region": ("r_regionkey", {}),
    "nation": ("n_nationkey", {"n_regionkey": "region"}),
    "customer": ("c_custkey", {"c_nationkey": "nation"}),
    "supplier": ("s_suppkey", {"s_nationkey": "nation"}),
    "part": ("p_partkey", {}),
    "orders": ("o_orderkey", {"o_custkey": "customer"}),
    "lineitem": (None, {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    "events": ("event_id", {}),
}


def map_tables(spark: SparkSession, folder: str, layout: dict[str, tuple[str | None, dict[str, str]]] = TPCH) -> MappedDataset:
    """The tables of ``layout`` under ``folder`` as a mapped dataset."""
    return MappedDataset(spark, {n: TableMap(n, spark.read.parquet(f"{folder}/{n}.parquet"), key, refs) for n, (key, refs) in layout.items()}, prefixes={"": "http://example.org/tpch#"})
