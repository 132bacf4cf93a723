"""Connected components by randomised contraction, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 80) -> DataFrame:
    """``(node, component)`` for every node of an edge; ``component`` is one node of the component.

    Each round gives the nodes a new random order, lets every node follow the first of itself and
    its neighbours, and contracts the edges along that. A round removes a constant share of the
    nodes whatever the shape, chains and stars included, so the rounds grow with the logarithm of
    the nodes. A node with many edges is met by map-side minima and by joins whose other side has
    one row a node, which adaptive execution can split. Every round is a written table.

    Edges with a null end and loops are ignored (their nodes are not returned unless another edge
    names them); repeated and reversed edges count once; no edges give no rows. It raises if
    ``max_rounds`` don't suffice, which no input of realistic size reaches.
    """
    left, right = F.col(src), F.col(dst)
    e = edges.where(left.isNotNull() & right.isNotNull() & (left != right)).select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).distinct()
    e = materialise(e, "edges")
    maps: list[DataFrame] = []
    while not e.isEmpty():
        if len(maps) == max_rounds:
            raise RuntimeError(f"components not found in {max_rounds} rounds")
        order = lambda c, r=len(maps): F.xxhash64(F.lit(r), c)
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min_by("b", order(F.col("b"))).alias("n"))
        own, other = order(F.col("a")), order(F.col("n"))
        follows = F.when(other < own, F.col("n")).when(other > own, F.col("a")).otherwise(F.least("a", "n"))
        rep = materialise(first.select(F.col("a").alias("node"), follows.alias("rep")), "reps")
        maps.append(rep)
        once = e.join(rep.select(F.col("node").alias("a"), F.col("rep").alias("ra")), "a")
        twice = once.join(rep.select(F.col("node").alias("b"), F.col("rep").alias("rb")), "b")
        e = materialise(twice.where(F.col("ra") != F.col("rb")).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps[-1].select("node", F.col("rep").alias("component"))
    for rep in reversed(maps[:-1]):
        later = found.select(F.col("node").alias("rep"), "component")
        found = rep.join(later, "rep", "left").select("node", F.coalesce("component", "rep").alias("component"))
    return materialise(found, "components")
