"""Typed values: a Spark column and what it is as an RDF term, known when the plan is built.

Kinds: ``bool int dec dbl str dt date`` hold native columns, ``node`` the string
of an IRI or blank node, ``key`` the native key of a mapped table row (its IRI is
made only when needed), ``term`` the general struct. Null is unbound or an error.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms as T

DATATYPES = {"bool": T.BOOLEAN, "int": T.INTEGER, "dec": T.DECIMAL, "dbl": T.DOUBLE, "str": T.STRING, "dt": T.DATETIME, "date": T.DATE}
NUMBERS = ("int", "dec", "dbl")


@dataclass(frozen=True)
class Value:
    kind: str
    col: Column
    #: key: the IRI before the key, or None for blank nodes
    prefix: str | None = None
    maybe: bool = True
    table: str | None = None

    def with_col(self, col: Column, **more) -> Value:
        return replace(self, col=col, **more)


def string(c) -> Value:
    return Value("str", c)


def boolean(c) -> Value:
    return Value("bool", c)


def nothing() -> Value:
    return Value("str", F.lit(None).cast("string"))


def lexical(v: Value) -> Column:
    """The lexical form, or the IRI; null for blank nodes only where the value is a term or node."""
    c = v.col
    if v.kind == "str":
        return c
    if v.kind == "node":
        return c
    if v.kind == "key":
        return F.concat(F.lit(v.prefix if v.prefix is not None else f"_:{v.table}-"), c.cast("string"))
    if v.kind == "term":
        return c["v"]
    if v.kind == "dt":
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(c, "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), F.regexp_replace(micros, "0+$", "")))
    if v.kind == "dec":
        s = c.cast("string")
        return F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", ".0")).otherwise(s)
    return c.cast("string")


def term(v: Value) -> Column:
    """The struct form."""
    if v.kind == "term":
        return v.col
    none = F.lit(None).cast("string")
    if v.kind in ("node", "key"):
        s = lexical(v)
        k = F.when(s.startswith("_:"), F.lit(T.BNODE_KIND)).otherwise(F.lit(T.IRI_KIND)).cast("tinyint")
        made = F.struct(k.alias("k"), s.alias("v"), none.alias("dt"), none.alias("lang"))
    else:
        made = F.struct(F.lit(T.LITERAL_KIND).cast("tinyint").alias("k"), lexical(v).alias("v"), F.lit(DATATYPES[v.kind]).alias("dt"), none.alias("lang"))
    return F.when(v.col.isNotNull(), made)


def node(v: Value) -> Column:
    """Subject form: IRI or blank node string; null for literals."""
    if v.kind == "term":
        return F.when(v.col["k"] != T.LITERAL_KIND, v.col["v"])
    if v.kind in ("node", "key"):
        return lexical(v)
    return F.lit(None).cast("string")


def literal(t: T.Term) -> Value:
    """A constant. Malformed literals of known datatypes stay terms."""
    if isinstance(t, (T.Iri, T.BNode)):
        return Value("node", F.lit(T.node_string(t)), maybe=False)
    try:
        if t.lang is None:
            if t.dt == T.STRING:
                return Value("str", F.lit(t.value), maybe=False)
            if t.dt == T.INTEGER and -(2**63) <= int(t.value) < 2**63 and str(int(t.value)) == t.value:
                return Value("int", F.lit(int(t.value)).cast("long"), maybe=False)
            if t.dt == T.DECIMAL:
                return Value("dec", F.lit(t.value).cast("decimal(38,18)"), maybe=False)
            if t.dt == T.DOUBLE:
                return Value("dbl", F.lit(float(t.value)), maybe=False)
            if t.dt == T.BOOLEAN and t.value in ("true", "false"):
                return Value("bool", F.lit(t.value == "true"), maybe=False)
            if t.dt == T.DATETIME:
                return Value("dt", _timestamp(F.lit(t.value)), maybe=False)
            if t.dt == T.DATE:
                return Value("date", F.lit(t.value).cast("date"), maybe=False)
    except ValueError:
        pass
    return Value("term", term_literal(t), maybe=False)


def term_literal(t: T.Term) -> Column:
    k, v, dt, lang = T.term_tuple(t)
    if k == T.BNODE_KIND:
        v = f"_:{v.removeprefix('_:')}"
    return F.struct(F.lit(k).cast("tinyint").alias("k"), F.lit(v).alias("v"), F.lit(dt).cast("string").alias("dt"), F.lit(lang).cast("string").alias("lang"))


def _timestamp(c: Column) -> Column:
    """Zone-less timestamps; a zoned literal is moved to UTC."""
    zoned = c.rlike(r"(Z|[+-]\d\d:\d\d)$")
    return F.when(zoned, F.to_utc_timestamp(F.try_to_timestamp(c), F.current_timezone()).cast("timestamp_ntz")).otherwise(c.try_cast("timestamp_ntz"))


def is_numeric(t: Column) -> Column:
    return (t["k"] == T.LITERAL_KIND) & t["dt"].isin(*sorted(T.NUMERIC))


def number(v: Value) -> Value | None:
    """A numeric value, or None where the kind can't be one."""
    if v.kind in NUMBERS:
        return v
    if v.kind == "term":
        return Value("dbl", F.when(is_numeric(v.col), v.col["v"].try_cast("double")))
    return None


def text(v: Value) -> Column:
    """The string of a simple or tagged literal, null for all else."""
    if v.kind == "str":
        return v.col
    if v.kind == "term":
        return F.when((v.col["k"] == T.LITERAL_KIND) & v.col["dt"].isin(T.STRING, T.LANG_STRING), v.col["v"])
    return F.lit(None).cast("string")


def like(v: Value, c: Column) -> Value:
    """A string result that keeps the language tag of ``v``."""
    if v.kind != "term":
        return string(c)
    made = F.struct(v.col["k"].alias("k"), c.alias("v"), v.col["dt"].alias("dt"), v.col["lang"].alias("lang"))
    return Value("term", F.when(c.isNotNull(), made))


def when_kind(v: Value) -> Column:
    """timestamp_ntz of a dateTime value, null for others."""
    if v.kind == "dt":
        return v.col.cast("timestamp_ntz")
    if v.kind == "date":
        return v.col.cast("timestamp_ntz")
    if v.kind == "term":
        return F.when((v.col["k"] == T.LITERAL_KIND) & v.col["dt"].isin(T.DATETIME, T.DATE, T.XSD + "dateTimeStamp"), _timestamp(v.col["v"]))
    return F.lit(None).cast("timestamp_ntz")


def ebv(v: Value) -> Column:
    """Effective boolean value; null on error."""
    c = v.col
    if v.kind == "bool":
        return c
    if v.kind in NUMBERS:
        return (c != 0) & ~F.isnan(c) if v.kind == "dbl" else c != 0
    if v.kind == "str":
        return F.length(c) > 0
    if v.kind == "term":
        n = c["v"].try_cast("double")
        return (
            F.when(c["k"] != T.LITERAL_KIND, F.lit(None).cast("boolean"))
            .when(c["dt"] == T.BOOLEAN, F.lower(c["v"]).isin("true", "1"))
            .when(c["dt"].isin(*sorted(T.NUMERIC)), F.coalesce((n != 0) & ~F.isnan(n), F.lit(False)))
            .when(c["dt"].isin(T.STRING, T.LANG_STRING), F.length(c["v"]) > 0)
        )
    return F.lit(None).cast("boolean")


def sort_keys(v: Value) -> list[Column]:
    """Unbound, blank nodes, IRIs, then literals by value."""
    if v.kind == "term":
        rank = F.when(v.col["k"] == T.BNODE_KIND, 1).when(v.col["k"] == T.IRI_KIND, 2).otherwise(3)
        return [F.when(v.col.isNotNull(), rank), F.when(is_numeric(v.col), v.col["v"].try_cast("double")), when_kind(v), v.col["v"], v.col["lang"]]
    if v.kind in ("node", "key"):
        s = lexical(v)
        return [F.when(s.isNotNull(), F.when(s.startswith("_:"), 1).otherwise(2)), s]
    return [v.col]


def same_term(a: Value, b: Value) -> Column:
    pair = comparable(a, b)
    if pair is None:
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    return pair[0] == pair[1]


def comparable(a: Value, b: Value) -> tuple[Column, Column] | None:
    """Two columns that are equal exactly if the terms are; None if they never are."""
    if a.kind == "key" and b.kind == "key":
        return (a.col, b.col) if a.table == b.table else None
    if {a.kind, b.kind} <= {"node", "key"}:
        return lexical(a), lexical(b)
    if a.kind == b.kind and a.kind != "term":
        return a.col, b.col
    if "term" not in (a.kind, b.kind):
        return None
    return term(a), term(b)


def equal(a: Value, b: Value) -> Column:
    """SPARQL ``=`` by value; null where the comparison is an error."""
    if a.kind in NUMBERS and b.kind in NUMBERS:
        return a.col == b.col
    if {a.kind, b.kind} <= {"dt", "date"}:
        return when_kind(a) == when_kind(b)
    nodes = ("node", "key")
    if "term" not in (a.kind, b.kind):
        if a.kind in nodes or b.kind in nodes or a.kind == b.kind:
            return same_term(a, b)
        return F.lit(None).cast("boolean")
    x, y = term(a), term(b)
    simple = lambda t: t["dt"].isin(T.STRING, T.LANG_STRING, T.BOOLEAN)
    both = lambda f: f(x) & f(y)
    return (
        F.when(x == y, True)
        .when((x["k"] != y["k"]) | (x["k"] != T.LITERAL_KIND), False)
        .when(both(is_numeric), x["v"].try_cast("double") == y["v"].try_cast("double"))
        .when(when_kind(Value("term", x)).isNotNull() & when_kind(Value("term", y)).isNotNull(), when_kind(Value("term", x)) == when_kind(Value("term", y)))
        .when(both(simple) & (x["dt"] == y["dt"]), (x["dt"] == T.BOOLEAN) & (F.lower(x["v"]).isin("true", "1") == F.lower(y["v"]).isin("true", "1")))
        .when(both(simple), False)
    )


def less(a: Value, b: Value, op: str) -> Column:
    """``<``, ``<=``, ``>``, ``>=`` by value; null for values without a common order."""

    def by(x: Column, y: Column) -> Column:
        return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    if a.kind == b.kind and a.kind in ("bool", "int", "dec", "dbl", "str", "dt", "date"):
        return by(a.col, b.col)
    if a.kind in NUMBERS and b.kind in NUMBERS:
        return by(a.col, b.col)
    if {a.kind, b.kind} <= {"dt", "date"}:
        return by(when_kind(a), when_kind(b))
    if "term" in (a.kind, b.kind):
        tries = []
        x, y = number(a), number(b)
        if x and y:
            tries.append(by(x.col, y.col))
        tries.append(by(when_kind(a), when_kind(b)))
        plain = lambda v: text(v) if v.kind != "term" else F.when(v.col["dt"] == T.STRING, text(v))
        tries.append(by(plain(a), plain(b)))
        return F.coalesce(*tries)
    return F.lit(None).cast("boolean")
