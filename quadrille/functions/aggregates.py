"""SPARQL aggregates over a group. One error makes SUM, AVG, MIN and MAX of the group an error; COUNT skips errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms as T
from .values import NUMBERS, Value, is_numeric, lexical, number, sort_keys, term, text


def aggregate(name: str, distinct: bool, v: Value | None, separator: str, row: Column | None = None) -> tuple[Column, Value]:
    """(aggregate column, shape of the result): the shape's ``col`` is a function of nothing yet and is replaced by the output column."""
    if name == "COUNT":
        if v is None:
            c = F.count_distinct(row) if distinct else F.count(F.lit(1))
        else:
            x = term(v) if v.kind == "term" else v.col
            c = F.count_distinct(x) if distinct else F.count(x)
        return c.cast("long"), Value("int", c, maybe=False)
    if name == "SAMPLE":
        c = F.min(v.col) if v.kind != "term" else F.min_by(v.col, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(sort_keys(v))]))
        return c, v
    if name == "GROUP_CONCAT":
        s = text(v) if v.kind == "term" else lexical(v)
        items = F.collect_set(s) if distinct else F.collect_list(s)
        bad = F.max(v.col.isNotNull() & s.isNull())
        c = F.when(~F.coalesce(bad, F.lit(False)), F.array_join(F.sort_array(items), separator))
        return c, Value("str", c)
    if name in ("MIN", "MAX"):
        f, by = (F.min, F.min_by) if name == "MIN" else (F.max, F.max_by)
        if v.kind == "term":
            c = by(v.col, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(sort_keys(v))]))
            return c, v
        return f(v.col), v
    # SUM and AVG
    if v.kind in NUMBERS:
        x = v.col
        if name == "SUM":
            total = F.sum_distinct(x) if distinct else F.sum(x)
            zero = {"int": F.lit(0).cast("long"), "dec": F.lit(0).cast("decimal(38,18)"), "dbl": F.lit(0.0)}[v.kind]
            kind = {"int": "long", "dec": "decimal(38,18)", "dbl": "double"}[v.kind]
            c = F.coalesce(total, zero).cast(kind)
            return c, v.with_col(c)
        if v.kind == "dbl":
            c = F.coalesce(F.avg(F.when(F.lit(True), x)) if not distinct else F.sum_distinct(x) / F.count_distinct(x), F.lit(0.0))
            return c, v.with_col(c)
        exact = x.cast("decimal(20,0)") if v.kind == "int" else x.cast("decimal(28,9)")
        total, n = (F.sum_distinct(exact), F.count_distinct(x)) if distinct else (F.sum(exact), F.count(x))
        c = F.coalesce(F.try_divide(total.cast("decimal(28,9)"), n.cast("decimal(20,0)")), F.lit(0)).try_cast("decimal(38,18)")
        return c, Value("dec", c)
    if v.kind != "term":
        c = F.when(F.count(v.col) == 0, F.lit(0.0))
        return c, Value("dbl", c)
    n = number(v).col
    total = F.sum_distinct(n) if distinct else F.sum(n)
    count = F.count_distinct(n) if distinct else F.count(n)
    bad = F.coalesce(F.max(v.col.isNotNull() & n.isNull()), F.lit(False))
    whole = F.coalesce(F.min(F.when(is_numeric(v.col), v.col["dt"].isin(*sorted(T.INTEGERS)))), F.lit(True))
    approx = F.coalesce(F.max(F.when(is_numeric(v.col), v.col["dt"].isin(T.DOUBLE, T.FLOAT))), F.lit(False))
    x = F.coalesce(total if name == "SUM" else total / count, F.lit(0.0))
    dt = F.when(approx, T.DOUBLE).when(whole if name == "SUM" else F.lit(False), T.INTEGER).otherwise(T.DECIMAL)
    form = F.when(dt == T.INTEGER, x.cast("decimal(38,0)").cast("string")).when(dt == T.DECIMAL, F.regexp_replace(F.regexp_replace(x.cast("decimal(38,15)").cast("string"), "0+$", ""), r"\.$", ".0")).otherwise(x.cast("string"))
    made = F.struct(F.lit(T.LITERAL_KIND).cast("tinyint").alias("k"), form.alias("v"), dt.alias("dt"), F.lit(None).cast("string").alias("lang"))
    c = F.when(~bad, made)
    return c, Value("term", c)
