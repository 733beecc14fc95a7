"""Relations of solutions: a DataFrame and, for each variable, its column and kind; and the joins of SPARQL."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import Value, comparable, lexical, term

_fresh = itertools.count()


def fresh(prefix: str = "v") -> str:
    return f"{prefix}{next(_fresh)}"


@dataclass(frozen=True)
class Slot:
    """A variable's column: ``kind`` as in values, ``maybe``: it may be unbound."""

    column: str
    kind: str
    maybe: bool = False
    prefix: str | None = None
    table: str | None = None

    def value(self) -> Value:
        return Value(self.kind, F.col(self.column), self.prefix, self.maybe, self.table)


def column_of(v: Value) -> Column:
    return v.col


@dataclass
class Relation:
    df: DataFrame
    slots: dict[str, Slot]

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @staticmethod
    def unit(spark: SparkSession) -> Relation:
        return Relation(spark.range(1).select(F.lit(True).alias(fresh("unit"))), {})

    @staticmethod
    def select(df: DataFrame, values: dict[str, Value], keep: list[str] | None = None) -> Relation:
        """A relation of exactly these variables (and the columns ``keep``), under fresh column names."""
        slots, columns = {}, []
        for name, v in values.items():
            c = fresh()
            slots[name] = Slot(c, v.kind, v.maybe, v.prefix, v.table)
            columns.append(v.col.alias(c))
        columns += [F.col(c) for c in keep or []]
        return Relation(df.select(*columns) if columns else df.select(F.lit(True).alias(fresh("unit"))), slots)

    def lookup(self, name: str) -> Value | None:
        s = self.slots.get(name)
        return s.value() if s else None

    def add(self, name: str, v: Value) -> Relation:
        c = fresh()
        return Relation(self.df.withColumn(c, v.col), self.slots | {name: Slot(c, v.kind, True, v.prefix, v.table)})

    def only(self, names: list[str]) -> Relation:
        have = {n: self.slots[n].value() for n in names if n in self.slots}
        return Relation.select(self.df, have)

    def filter(self, condition: Column) -> Relation:
        return Relation(self.df.filter(condition), self.slots)

    def renamed(self) -> Relation:
        """Fresh column names: both sides of a self-join must differ."""
        return Relation.select(self.df, {n: s.value() for n, s in self.slots.items()})


def _shared(left: Relation, right: Relation) -> list[str]:
    return [n for n in left.slots if n in right.slots]


def _pairs(left: Relation, right: Relation, names: list[str]) -> list[tuple[str, Column, Column, bool]] | None:
    """(variable, left column, right column, whether either may be unbound); None: no pair of rows is ever compatible."""
    out = []
    for n in names:
        a, b = left.slots[n], right.slots[n]
        both = comparable(a.value(), b.value())
        if both is None:
            if not (a.maybe or b.maybe):
                return None
            both = term(a.value()), term(b.value())
        out.append((n, *both, a.maybe or b.maybe))
    return out


def _compatible(pairs) -> Column:
    condition = F.lit(True)
    for _, x, y, maybe in pairs:
        condition = condition & (((x == y) | x.isNull() | y.isNull()) if maybe else (x == y))
    return condition


def _merged(left: Relation, right: Relation, pairs, outer: bool) -> tuple[list[Column], dict[str, Slot]]:
    """Columns of the joined row. Unbound on the left takes the right value."""
    columns, slots = [], {}
    shared = {n: (x, y, maybe) for n, x, y, maybe in pairs}
    for n, s in left.slots.items():
        if n not in shared or not s.maybe:
            columns.append(F.col(s.column))
            slots[n] = s
            continue
        r = right.slots[n]
        a, b = s.value(), r.value()
        c = fresh()
        if a.kind == b.kind and (a.kind != "key" or a.table == b.table):
            columns.append(F.coalesce(a.col, b.col).alias(c))
            slots[n] = replace(s, column=c, maybe=s.maybe and (r.maybe or outer))
        elif {a.kind, b.kind} <= {"key", "node"}:
            columns.append(F.coalesce(lexical(a), lexical(b)).alias(c))
            slots[n] = Slot(c, "node", s.maybe and (r.maybe or outer))
        else:
            columns.append(F.coalesce(term(a), term(b)).alias(c))
            slots[n] = Slot(c, "term", s.maybe and (r.maybe or outer))
    for n, s in right.slots.items():
        if n not in shared:
            columns.append(F.col(s.column))
            slots[n] = replace(s, maybe=s.maybe or outer)
    if not columns:
        columns = [F.lit(True).alias(fresh("unit"))]
    return columns, slots


def join(left: Relation, right: Relation) -> Relation:
    """Compatible mappings; an equi-join wherever both sides surely bind the shared variables."""
    right = right.renamed()
    names = _shared(left, right)
    pairs = _pairs(left, right, names)
    if pairs is None:
        columns, slots = _merged(left, right, [(n, F.lit(None), F.lit(None), False) for n in names], False)
        return Relation(left.df.crossJoin(right.df).filter(F.lit(False)).select(*columns), slots)
    if not pairs:
        joined = left.df.crossJoin(right.df)
    else:
        joined = left.df.join(right.df, _compatible(pairs), "inner")
    columns, slots = _merged(left, right, pairs, False)
    return Relation(joined.select(*columns), slots)


#: ranges across the span of a band join, and shares of each range
_RANGES, _SHARES = 8, 8


def band_join(left: Relation, right: Relation, low: Column, high: Column, value: Column, span: float) -> Relation:
    """Pairs that may have ``low <= value <= high``, by ranges of the value; the exact comparison is left to the caller.

    ``low`` and ``high`` are of the left row, ``span`` apart. Without shared variables, and ``right`` under names of its own.
    """
    a, b, share = fresh("band"), fresh("band"), fresh("share")

    def at(c: Column) -> Column:  # rises with the value; the ends take what a long can't hold
        return F.floor(F.greatest(F.least(c.cast("double") / (span / _RANGES), F.lit(1e15)), F.lit(-1e15)))

    mine = left.df.filter(low.isNotNull() & high.isNotNull()).withColumn(share, F.pmod(F.xxhash64(*[F.col(s.column) for s in left.slots.values()]), F.lit(_SHARES)))
    mine = mine.withColumn(a, F.explode(F.sequence(at(low), at(high))))
    theirs = right.df.filter(value.isNotNull()).withColumn(b, at(value)).withColumn(share + "r", F.explode(F.array(*[F.lit(i).cast("long") for i in range(_SHARES)])))
    # small tables come in one task, and their pairs are many
    n = min(int(left.spark.conf.get("spark.sql.shuffle.partitions")), 4 * left.spark.sparkContext.defaultParallelism)
    joined = mine.repartition(n, a, share).join(theirs, (F.col(a) == F.col(b)) & (F.col(share) == F.col(share + "r")))
    columns, slots = _merged(left, right, [], False)
    return Relation(joined.select(*columns), slots)


def left_join(left: Relation, right: Relation, condition: Callable[[Relation], Column] | None = None) -> Relation:
    """OPTIONAL: ``condition`` sees the merged row and decides on the match, not on the row."""
    right = right.renamed()
    names = _shared(left, right)
    pairs = _pairs(left, right, names)
    never = pairs is None
    pairs = pairs or []
    on = F.lit(False) if never else _compatible(pairs)
    if condition is not None and not never:
        columns, slots = _merged(left, right, pairs, False)
        merged: dict[str, Slot] = {n: left.slots[n] if n in left.slots else s for n, s in slots.items()}
        view = Relation(left.df, merged)
        coalesced = {n for n in names if left.slots[n].maybe}
        on = on & F.coalesce(condition(_View(view, left, right, coalesced)), F.lit(False))
    joined = left.df.join(right.df, on, "left")
    columns, slots = _merged(left, right, pairs if not never else [(n, F.lit(None), F.lit(None), False) for n in names], True)
    return Relation(joined.select(*columns), slots)


class _View(Relation):
    """The merged row while it is being joined."""

    def __init__(self, base: Relation, left: Relation, right: Relation, coalesced: set[str]):
        super().__init__(base.df, base.slots)
        self.left, self.right, self.coalesced = left, right, coalesced

    def lookup(self, name: str) -> Value | None:
        if name in self.coalesced:
            a, b = self.left.slots[name].value(), self.right.slots[name].value()
            if a.kind == b.kind and a.table == b.table:
                return a.with_col(F.coalesce(a.col, b.col))
            return Value("term", F.coalesce(term(a), term(b)))
        return super().lookup(name)


def union(left: Relation, right: Relation) -> Relation:
    """Bag union; variables of one side are unbound in the other's rows."""
    names = list(dict.fromkeys([*left.slots, *right.slots]))
    la, ra, slots = [], [], {}
    for n in names:
        a, b = left.slots.get(n), right.slots.get(n)
        c = fresh()
        if a and b:
            x, y = a.value(), b.value()
            maybe = a.maybe or b.maybe
            if x.kind == y.kind and (x.kind != "key" or x.table == y.table) and dict(left.df.dtypes)[a.column] == dict(right.df.dtypes)[b.column]:
                cols, slot = (x.col, y.col), replace(a, column=c, maybe=maybe)
            elif {x.kind, y.kind} <= {"key", "node"}:
                cols, slot = (lexical(x), lexical(y)), Slot(c, "node", maybe)
            else:
                cols, slot = (term(x), term(y)), Slot(c, "term", maybe)
        else:
            one = a or b
            none = F.lit(None).cast(dict((left if a else right).df.dtypes)[one.column])
            cols = (F.col(one.column), none) if a else (none, F.col(one.column))
            slot = replace(one, column=c, maybe=True)
        la.append(cols[0].alias(c))
        ra.append(cols[1].alias(c))
        slots[n] = slot
    if not names:
        c = fresh("unit")
        return Relation(left.df.select(F.lit(True).alias(c)).union(right.df.select(F.lit(True).alias(c))), {})
    return Relation(left.df.select(*la).union(right.df.select(*ra)), slots)


def minus(left: Relation, right: Relation) -> Relation:
    """Drop rows compatible with a right row that shares a bound variable; without shared variables nothing goes."""
    names = _shared(left, right)
    if not names:
        return left
    right = right.only(names)
    pairs = _pairs(left, right, names)
    if pairs is None:
        return left
    right_df = right.df.distinct()
    on = _compatible(pairs)
    if any(maybe for *_, maybe in pairs):
        bound = F.lit(False)
        for _, x, y, _ in pairs:
            bound = bound | (x.isNotNull() & y.isNotNull())
        on = on & bound
    return Relation(left.df.join(right_df, on, "left_anti"), left.slots)


def semi(left: Relation, right: Relation, anti: bool = False, condition: Callable[[Relation], Column] | None = None) -> Relation:
    """EXISTS / NOT EXISTS: rows with (without) a compatible right row that passes ``condition``."""
    right = right.renamed()
    names = _shared(left, right)
    pairs = _pairs(left, right, names)
    if pairs is None:
        return left if anti else left.filter(F.lit(False))
    on = _compatible(pairs)
    if condition is not None:
        view = Relation(left.df, right.slots | left.slots)
        on = on & F.coalesce(condition(view), F.lit(False))
    return Relation(left.df.join(right.df, on, "left_anti" if anti else "left_semi"), left.slots)
