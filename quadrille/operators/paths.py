"""Transitive property paths as fixpoints over edge frames.

Each round is written to the shared folder, so a loop of any length keeps a plan
of constant size and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(x, y) with a number for each node, and (i, node); None for the second where nodes are whole numbers already. Rows stay as many as they are."""
    edges = edges.toDF("x", "y").filter("x is not null and y is not null")
    if edges.schema["x"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        return staged(edges, "path-edges"), None
    edges = staged(edges, "path-edges")
    nodes = edges.select(F.col("x").alias("node")).union(edges.select("y")).distinct()
    nodes = staged(nodes.select(F.monotonically_increasing_id().alias("i"), "node"), "path-nodes")
    for end in ("x", "y"):
        edges = edges.join(nodes.toDF("i", "n"), F.col(end) == F.col("n")).withColumn(end, F.col("i")).select("x", "y")
    return staged(edges, "path-edges"), nodes


def _named(pairs: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """Nodes for their numbers."""
    if nodes is None:
        return pairs
    for end in ("x", "y"):
        pairs = pairs.join(nodes.toDF("i", "n"), F.col(end) == F.col("i")).withColumn(end, F.col("n")).select("x", "y")
    return pairs


def closure(edges: DataFrame) -> DataFrame:
    """(x, y) of one and more steps, as a set. Doubling: as many rounds as the logarithm of the longest path.

    A round extends walks of up to n steps by those of just n, so a pair is met once for each length of walk, not for each
    node between; nodes are numbers meanwhile.
    """
    edges, nodes = _numbered(edges)
    reach = power = staged(edges.distinct(), "path")
    while True:
        more = reach.toDF("x", "m").join(power.toDF("m", "y"), "m").select("x", "y").distinct()
        more = staged(more.join(reach, ["x", "y"], "left_anti"), "path")
        if more.isEmpty():
            return _named(reach, nodes)
        reach = reach.union(more)
        power = staged(power.toDF("x", "m").join(power.toDF("m", "y"), "m").select("x", "y").distinct(), "path-power")


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(x, y): nodes y of one and more steps from the nodes in ``starts`` (x). Semi-naive: only new pairs go on."""
    edges = staged(edges.toDF("m", "y").filter("m is not null and y is not null").distinct(), "path-edges")
    step = starts.toDF("x").distinct().join(edges.toDF("x", "y"), "x").select("x", "y").distinct()
    frontier = staged(step, "path")
    seen = frontier
    while not frontier.isEmpty():
        step = frontier.toDF("x", "m").join(edges, "m").select("x", "y").distinct()
        frontier = staged(step.join(seen, ["x", "y"], "left_anti"), "path")
        seen = seen.union(frontier)
    return seen


def bounded(edges: DataFrame, least: int, most: int, zero: DataFrame | None) -> DataFrame:
    """(x, y) of ``least`` to ``most`` steps with bag semantics; ``zero``: the pairs of no step."""
    edges = edges.toDF("x", "y")
    walk, out = edges, []
    if least == 0 and zero is not None:
        out.append(zero)
    for n in range(1, most + 1):
        if n > 1:
            walk = walk.toDF("x", "m").join(edges.toDF("m", "y"), "m").select("x", "y")
        if n >= least:
            out.append(walk)
    result = out[0] if out else edges.filter(F.lit(False))
    for more in out[1:]:
        result = result.union(more)
    return result


def superclasses(sub: DataFrame, child: str = "c", parent: str = "d") -> DataFrame:
    """Transitive superclasses (c, d) of a direct-subclass table."""
    return closure(sub.select(child, parent)).toDF(child, parent)


