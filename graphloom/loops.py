"""Frontier loops and fixpoints over edge DataFrames.

State is checkpointed each round, so plans stay small; only counts reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut


def bfs(edges: DataFrame, seeds: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows (id, depth): what is reachable from ``seeds`` (id) along src to dst; seeds have depth 0."""
    seen = [cut(seeds.select("id").distinct().withColumn("depth", F.lit(0).cast("long")))]
    step = cut(edges.select("src", "dst").distinct())
    depth = 0
    while limit is None or depth < limit:
        depth += 1
        reached = step.join(seen[-1].select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        new = cut(reached.join(reduce(DataFrame.union, seen), "id", "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if new.isEmpty():
            break
        seen.append(new)
    return reduce(DataFrame.union, seen)


def shortest(edges: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows (s, v, d, sigma): distance and number of shortest paths (parallel edges count) from each source."""
    first = sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).cast("long").alias("d"), F.lit(1.0).alias("sigma"))
    seen, d = [cut(first)], 0
    step = cut(edges.select("src", "dst"))
    while limit is None or d < limit:
        d += 1
        reached = step.join(seen[-1].withColumnRenamed("v", "src"), "src").groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
        new = cut(reached.join(reduce(DataFrame.union, seen), ["s", "v"], "left_anti").select("s", "v", F.lit(d).cast("long").alias("d"), "sigma"))
        if new.isEmpty():
            break
        seen.append(new)
    return reduce(DataFrame.union, seen)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (id, label) for every node: the smallest id it is connected with.

    Neighbours' least label, then that label's label; logarithmic rounds on long chains.
    """
    both = cut(edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(edges.select("dst", "src")).filter("id <> other").distinct())
    state = cut(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = both.join(state.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("m"))
        met = state.join(near, "id", "left").select("id", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("old"))
        jump = state.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = cut(met.join(jump, "label").select("id", F.least("label", "further").alias("label"), "old"))
        if new.filter("label <> old").isEmpty():
            return new.select("id", "label")
        state = new.select("id", "label")


def stripped_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``components``, for edges between nodes: leaves are taken off first and get their neighbour's label.

    Rounds go on while they halve the pairs; ``components`` settles the rest.
    """
    # both directions of an edge from one reading of it
    both = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"))))
    pairs = cut(edges.filter("src <> dst").select(both.alias("e")).select("e.id", "e.other").distinct())
    left, n, taken = nodes.select("id").distinct(), pairs.count(), []
    low = left.limit(0).withColumn("low", F.col("id"))
    while n:
        ends = pairs.groupBy("id").agg(F.count("*").alias("n"), F.min("other").alias("parent")).filter("n = 1").select("id", "parent")
        # of two nodes that have only each other, the smaller one stays
        other = ends.select(F.col("id").alias("parent"), F.lit(True).alias("leaf"))
        leaf = cut(ends.join(other, "parent", "left").filter("leaf IS NULL OR id > parent").select("id", "parent"))
        off = leaf.select("id")
        pairs = cut(pairs.join(off, "id", "left_anti").join(off.withColumnRenamed("id", "other"), "other", "left_anti").select("id", "other"))
        given = leaf.join(low, "id", "left").groupBy(F.col("parent").alias("id")).agg(F.min(F.least("id", F.coalesce("low", "id"))).alias("low"))
        low = cut(low.join(off, "id", "left_anti").union(given).groupBy("id").agg(F.min("low").alias("low")))
        taken.append(leaf)
        m = pairs.count()
        if 2 * m > n:
            break
        n = m
    for leaf in taken:
        left = left.join(leaf.select("id"), "id", "left_anti")
    left = cut(left)
    core = components(pairs.toDF("src", "dst"), left).withColumnRenamed("label", "part")
    core = core.join(low, "id", "left").select("id", "part", F.least("id", F.coalesce("low", "id")).alias("low"))
    label = cut(core.join(core.groupBy("part").agg(F.min("low").alias("label")), "part").select("id", "label"))
    for leaf in reversed(taken):
        # a leaf's neighbour was taken off in a later round or stayed
        label = label.union(leaf.join(label.toDF("parent", "label"), "parent").select("id", "label"))
    return label


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges (src, dst) without those that cannot be on a cycle: their start is no end, or their end no start, of another.

    Rounds go on while they halve the edges, so some that are on no cycle may stay.
    """
    core = edges.select("src", "dst").filter("src <> dst")
    n = core.count()
    while n:
        ends, starts = core.select(F.col("dst").alias("src")).distinct(), core.select(F.col("src").alias("dst")).distinct()
        core = cut(core.join(ends, "src", "left_semi").join(starts, "dst", "left_semi").select("src", "dst"))
        m = core.count()
        if 2 * m > n:
            break
        n = m
    return core


def closure(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (s, v): v is reachable from s by at least one edge."""
    return shortest(edges.distinct(), nodes).filter("d > 0").select("s", "v").union(_on_cycle(edges, nodes)).distinct()


def _on_cycle(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (s, s) of the nodes on a directed cycle."""
    far = shortest(edges.distinct(), nodes).select("s", "v")
    back = edges.select(F.col("src").alias("v"), F.col("dst").alias("s")).distinct()
    return far.join(back, ["s", "v"]).select("s", F.col("s").alias("v")).distinct()
