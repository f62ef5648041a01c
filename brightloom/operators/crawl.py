"""Breadth-first crawls with a visited set and a budget of nodes, and numbers of sorted rows.

Levels are joins of the frontier with the edges. A crawl that is still going on after some levels is
likely on long paths, where one job a level doesn't end; then nodes that just pass on (one edge in, one
out) are drawn together by doubling pointers, and the levels go on over what is left, with lengths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .linkage import written

#: Levels before paths are drawn together.
DIRECT = 8


def running(df: DataFrame, order: Sequence[str], value: Column, name: str = "n") -> DataFrame:
    """``df`` with the running sum of ``value`` (whole numbers) over all rows in order, the row itself
    included, as ``name``. Rows are sorted in ranges; a range needs only the sums of those before it."""
    sums = df.withColumn("_value", value.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(sums.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    inside = F.sum("_value").over(Window.partitionBy("_part").orderBy("_id"))
    rows = rows.withColumn("_part", part).withColumn("_inside", inside)
    before = rows.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    before = before.withColumn("_before", F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).drop("_sum")  # a row a range
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_inside") + F.col("_before")).drop("_value", "_id", "_part", "_inside", "_before")


def numbered(df: DataFrame, order: Sequence[str], name: str = "n") -> DataFrame:
    """``df`` with the number of each row in order, from 1."""
    return running(df, order, F.lit(1), name)


def crawl(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """``node, depth`` of all nodes that ``edges`` (node, child) lead to from ``roots`` (node), each once
    with its least depth; with ``most``, the first so many of them by depth, then node.

    Levels end as soon as the budget is reached. Loops, repeated edges and roots, and nulls (which lead
    nowhere) are fine. There is no limit of depth.
    """
    edges = written(edges.toDF("node", "child").where("node IS NOT NULL AND child IS NOT NULL AND node <> child").distinct())
    level = written(roots.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0).cast("long")))
    seen, depth, visited = level, 0, level.count() if most is not None else 0
    while not level.isEmpty() and (most is None or visited < most):
        if depth == DIRECT:
            seen = seen.unionByName(_along_paths(edges, seen, level))
            break
        depth += 1
        level = level.join(edges, "node").select(F.col("child").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        level = written(level.withColumn("depth", F.lit(depth).cast("long")))
        seen = seen.unionByName(level)
        visited += level.count() if most is not None else 0
    if most is None:
        return seen
    return numbered(seen, ["depth", "node"], "_n").where(F.col("_n") <= most).drop("_n")


def _along_paths(edges: DataFrame, seen: DataFrame, frontier: DataFrame) -> DataFrame:
    """Nodes beyond the frontier with their depths."""
    edges = written(edges.join(seen.select(F.col("node").alias("child")), "child", "left_anti").select("node", "child"))
    ins = edges.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("ins"), F.min("node").alias("before"))
    outs = edges.groupBy("node").agg(F.count("*").alias("outs"), F.min("child").alias("after"))
    passing = written(ins.where("ins = 1").join(outs.where("outs = 1"), "node").join(frontier.select("node"), "node", "left_anti").select("node", "before", "after"))
    # Each passing node points back to the head of its path; after enough rounds only closed loops don't.
    heads = written(passing.select("node", F.col("before").alias("head"), F.lit(1).cast("long").alias("length")))
    for _ in range(max(heads.count(), 1).bit_length() + 1):
        a, b = heads.alias("a"), heads.alias("b")
        moved = a.join(b, F.col("a.head") == F.col("b.node"), "left").select("a.node", F.coalesce("b.head", "a.head").alias("head"), (F.col("a.length") + F.coalesce("b.length", F.lit(0))).alias("length"), F.col("b.node").isNotNull().alias("_moved"))
        moved = written(moved)
        heads = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            break
    heads = written(heads.join(passing.select(F.col("node").alias("head")), "head", "left_anti"))
    inner = passing.select("node")
    plain = edges.join(inner, "node", "left_anti").join(inner.withColumnRenamed("node", "child"), "child", "left_anti").select("node", "child", F.lit(1).cast("long").alias("length"))
    ends = passing.join(inner.withColumnRenamed("node", "after"), "after", "left_anti").select("node", "after")
    drawn = written(plain.unionByName(heads.join(ends, "node").select(F.col("head").alias("node"), F.col("after").alias("child"), (F.col("length") + 1).alias("length"))))
    best = active = frontier
    while not active.isEmpty():
        reached = active.join(drawn, "node").groupBy(F.col("child").alias("node")).agg(F.min(F.col("depth") + F.col("length")).alias("depth"))
        better = reached.join(best.withColumnRenamed("depth", "_best"), "node", "left").where("_best IS NULL OR depth < _best").select("node", "depth")
        active = written(better)
        best = written(best.join(active.select("node"), "node", "left_anti").unionByName(active))
    along = heads.join(best.withColumnRenamed("node", "head"), "head").select("node", (F.col("depth") + F.col("length")).alias("depth"))
    return best.join(frontier.select("node"), "node", "left_anti").unionByName(along)
