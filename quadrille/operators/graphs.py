"""Graph algebra: disjoint unions, deltas, and full and difference models."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import terms as T
from ..dataset import QuadDataset

SPO = ["s", "p", "o"]
FULL_MODEL, DIFFERENCE_MODEL = T.MD + "FullModel", T.DM + "DifferenceModel"
FORWARD, REVERSE, PRECONDITIONS = T.DM + "forwardDifferences", T.DM + "reverseDifferences", T.DM + "preconditions"


def _without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*SPO).distinct(), SPO, "left_anti").select(*SPO)


def disjoint_union(*graphs: DataFrame) -> DataFrame:
    """Concatenation of graphs known to be disjoint: nothing is compared."""
    return reduce(DataFrame.unionByName, [g.select(*SPO) for g in graphs])


def same_graph(a: DataFrame, b: DataFrame) -> bool:
    """Equal up to triples with blank nodes, whose numbers must agree."""
    ground = lambda g: g.select(*SPO).filter(~F.col("s").startswith("_:") & (F.col("o.k") != T.BNODE_KIND))
    x, y = ground(a), ground(b)
    return a.count() == b.count() and x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


@dataclass
class Delta:
    """A base graph with additions and deletions, as sets: (base - deletions) | additions. All frames are (s, p, o)."""

    base: DataFrame
    additions: DataFrame
    deletions: DataFrame

    @staticmethod
    def on(base: DataFrame) -> Delta:
        none = base.select(*SPO).limit(0)
        return Delta(base, none, none)

    def add(self, triples: DataFrame) -> Delta:
        """Added triples leave the deletions, and are additions only where the base lacks them."""
        t = triples.select(*SPO).distinct()
        return replace(self, additions=self.additions.union(_without(t, self.base)).distinct(), deletions=_without(self.deletions, t))

    def delete(self, triples: DataFrame) -> Delta:
        t = triples.select(*SPO).distinct()
        return replace(self, additions=_without(self.additions, t), deletions=self.deletions.union(t.join(self.base.select(*SPO).distinct(), SPO, "left_semi").select(*SPO)).distinct())

    def has_changes(self) -> bool:
        return not (self.additions.isEmpty() and self.deletions.isEmpty())

    def rebase(self, base: DataFrame) -> Delta:
        return replace(self, base=base)

    def graph(self) -> DataFrame:
        return _without(self.base.select(*SPO).distinct(), self.deletions).union(self.additions.select(*SPO)).distinct()

    def size(self) -> int:
        return self.graph().count()


class ModelError(ValueError):
    pass


class Model:
    """A full or difference model in a quad dataset."""

    def __init__(self, data: QuadDataset):
        self.data = data

    def _kind(self, g: str) -> bool:
        return not self.data.quads.filter((F.col("g") == g) & (F.col("p") == T.RDF_TYPE) & (F.col("o.v") == g)).isEmpty()

    def is_full(self) -> bool:
        return self._kind(FULL_MODEL)

    def is_difference(self) -> bool:
        return self._kind(DIFFERENCE_MODEL)

    def header(self) -> DataFrame:
        if self.is_full():
            return self.data.graph(FULL_MODEL)
        if self.is_difference():
            return self.data.graph(DIFFERENCE_MODEL)
        raise ModelError("neither a full nor a difference model")

    def body(self) -> DataFrame:
        if not self.is_full():
            raise ModelError("only a full model has a body")
        return self.data.default_graph()

    def _container(self, g: str) -> DataFrame:
        if not self.is_difference():
            raise ModelError("only a difference model has difference containers")
        return self.data.graph(g)

    def forward(self) -> DataFrame:
        return self._container(FORWARD)

    def reverse(self) -> DataFrame:
        return self._container(REVERSE)

    def preconditions(self) -> DataFrame:
        return self._container(PRECONDITIONS)

    def iri(self) -> str:
        found = self.header().filter((F.col("p") == T.RDF_TYPE) & F.col("o.v").isin(FULL_MODEL, DIFFERENCE_MODEL)).select("s").distinct().limit(2).collect()
        if len(found) != 1:
            raise ModelError(f"{len(found)} model headers")
        return found[0][0]

    def _values(self, name: str) -> list[str]:
        """Values of a header property; texts count as IRIs."""
        return sorted({r[0] for r in self.header().filter(F.col("p") == T.MD + name).select("o.v").collect()})

    def profiles(self) -> list[str]:
        return self._values("Model.profile")

    def supersedes(self) -> list[str]:
        return self._values("Model.Supersedes")

    def dependent_on(self) -> list[str]:
        return self._values("Model.DependentOn")

    def to_single_graph(self) -> DataFrame:
        return self.body().union(self.header()).distinct()

    def apply(self, predecessor: Model, strict_supersedes: bool = True) -> Delta:
        """The predecessor's body after this difference.

        Fails unless this is a difference model, the predecessor a full model that
        is listed in Supersedes (by string, so texts and IRIs agree), and all
        preconditions hold; the error lists missing ones.
        """
        if not self.is_difference():
            raise ModelError("only a difference model can be applied")
        if not predecessor.is_full():
            raise ModelError("a difference applies to a full model")
        if strict_supersedes and predecessor.iri() not in self.supersedes():
            raise ModelError(f"{predecessor.iri()} is not superseded by {self.iri()}")
        base = predecessor.body()
        missing = _without(self.preconditions().distinct(), base).limit(20).collect()
        if missing:
            raise ModelError("Preconditions don't hold: " + "; ".join(f"{r.s} {r.p} {r.o.v}" for r in missing))
        return Delta(base, self.forward(), self.reverse())


def apply_differences(base: DataFrame, changes: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """A chain of (forward, reverse) graphs; every fourth step is staged so that plans stay small."""
    from ..session import staged

    for i, (forward, reverse) in enumerate(changes):
        base = Delta(base, forward, reverse).graph()
        if i % 4 == 3:
            base = staged(base, "differences")
    return base
