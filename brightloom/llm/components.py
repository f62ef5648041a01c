"""Connected components by contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a, b: long); nodes of a component share a root.

    Each round gives every node the smallest of itself and its neighbours, in the order of a hash, and
    replaces both ends of each edge by that; edges inside one node go. A constant share of the nodes is
    expected to go in a round, so rounds grow with the logarithm of the size, and the table shrinks.
    Each round's table is written to the shared folder, and the roots are composed at the end.
    """

    def order(c: str) -> F.Column:
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))

    edges = cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        best = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        step = cut(best.select(F.col("a").alias("node"), F.least("m", order("a"))["n"].alias("root")), "step")
        levels.append(step)
        a, b = step.toDF("a", "ra"), step.toDF("b", "rb")
        moved = edges.join(a, "a").join(b, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = cut(moved.where("a <> b").distinct(), "edges")
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = levels.pop()
    while levels:
        lower = levels.pop()
        upper = roots.toDF("root", "upper")
        roots = cut(lower.join(upper, "root", "left").select("node", F.coalesce("upper", "root").alias("root")), "roots")
    return roots
