"""Classical algorithms with unit weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom import loops
from graphloom.graph import Graph, local_edges, undirected
from graphloom.operators.navigation import paths, why
from graphloom.session import cut

FLOYD_LIMIT = 2000


def bellman_ford(g: Graph, source: str, k: int = 50) -> DataFrame:
    """(id, d): distances from one node, nearest first."""
    reached = loops.bfs(local_edges(g.nodes, g.edges), g.nodes.filter(F.col("id") == source))
    return reached.select("id", F.col("depth").alias("d")).orderBy("d", "id").limit(k)


def astar(g: Graph, a: str, b: str) -> DataFrame:
    """(step, id): with unit weights and no heuristic, the smallest shortest path; no rows where b is not reached from a."""
    return why(local_edges(g.nodes, g.edges), a, b, back=False)


def kshortest(g: Graph, a: str, b: str, k: int = 5, depth: int = 10) -> DataFrame:
    """(length, path): the k shortest simple paths of at most ``depth`` edges."""
    return paths(local_edges(g.nodes, g.edges), a, b, depth, k)


def floyd_warshall(g: Graph) -> DataFrame:
    """One row (diameter, radius, pairs); refuses more nodes than the all-pairs limit."""
    if g.nodes.count() > FLOYD_LIMIT:
        raise ValueError(f"all pairs of more than {FLOYD_LIMIT} nodes")
    far = loops.shortest(local_edges(g.nodes, g.edges).distinct(), g.nodes).filter("d > 0")
    ecc = far.groupBy("s").agg(F.max("d").alias("e"), F.count("*").alias("n"))
    return ecc.agg(F.max("e").alias("diameter"), F.min("e").alias("radius"), F.sum("n").alias("pairs"))


def diameter(g: Graph) -> DataFrame:
    """One row (diameter, s, v): the longest shortest path, its smallest end points."""
    far = loops.shortest(local_edges(g.nodes, g.edges).distinct(), g.nodes)
    return far.orderBy(F.col("d").desc(), "s", "v").limit(1).select(F.col("d").alias("diameter"), "s", "v")


def mst(g: Graph) -> DataFrame:
    """(u, v): the spanning forest that Kruskal finds over ordered id pairs, by Boruvka rounds.

    Pairs are distinct, so with their order as weight the forest is unique.
    """
    pairs = cut(undirected(local_edges(g.nodes, g.edges)).filter("x < y").toDF("u", "v"))
    label = cut(g.nodes.select("id", F.col("id").alias("label")))
    chosen = []
    while True:
        lu, lv = label.select(F.col("id").alias("u"), F.col("label").alias("lu")), label.select(F.col("id").alias("v"), F.col("label").alias("lv"))
        across = pairs.join(lu, "u").join(lv, "v").filter("lu <> lv")
        ends = across.select(F.col("lu").alias("c"), "u", "v").union(across.select(F.col("lv"), "u", "v"))
        best = cut(ends.groupBy("c").agg(F.min(F.struct("u", "v")).alias("m")).select("m.u", "m.v").distinct())
        if best.isEmpty():
            break
        chosen.append(best)
        joined = best.join(lu, "u").join(lv, "v").select(F.col("lu").alias("src"), F.col("lv").alias("dst"))
        merged = loops.components(joined, label.select(F.col("label").alias("id")).distinct()).toDF("label", "new")
        label = cut(label.join(merged, "label").select("id", F.col("new").alias("label")))
    return reduce(DataFrame.union, chosen) if chosen else pairs.limit(0)


def scc(g: Graph) -> DataFrame:
    """(id, component): strongly connected components by their smallest id.

    Nodes take the largest id that reaches them (forward colouring); what a colour's owner
    can be reached from within the colour is its component; the rest goes round again.
    """
    rest_n, rest_e = cut(g.nodes.select("id")), cut(local_edges(g.nodes, g.edges).filter("src <> dst").distinct())
    parts = []
    while not rest_n.isEmpty():
        colour = cut(rest_n.select("id", F.col("id").alias("c")))
        while True:
            near = rest_e.join(colour.toDF("src", "cs"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("cs").alias("m"))
            new = cut(colour.join(near, "id", "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("old")))
            colour = new.select("id", "c")
            if new.filter("c <> old").isEmpty():
                break
        same = rest_e.join(colour.toDF("src", "c1"), "src").join(colour.toDF("dst", "c2"), "dst").filter("c1 = c2").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = loops.bfs(same, colour.filter("id = c")).select("id").join(colour, "id")
        found = cut(found)
        parts.append(found)
        rest_n = cut(rest_n.join(found, "id", "left_anti"))
        rest_e = cut(local_edges(rest_n, rest_e))
    if not parts:
        return g.nodes.select("id", F.col("id").alias("component")).limit(0)
    flat = reduce(DataFrame.union, parts)
    return flat.select("id", F.min("id").over(Window.partitionBy("c")).alias("component"))


def topo_sort(g: Graph) -> DataFrame:
    """(id, level): rounds of nodes without unplaced predecessors; nodes on or behind a cycle have no row."""
    nodes, edges, level, out = cut(g.nodes.select("id")), cut(local_edges(g.nodes, g.edges).distinct()), 0, []
    while True:
        free = cut(nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti"))
        if free.isEmpty():
            break
        out.append(free.withColumn("level", F.lit(level).cast("long")))
        nodes = cut(nodes.join(free, "id", "left_anti"))
        edges = cut(edges.join(free.withColumnRenamed("id", "src"), "src", "left_anti"))
        level += 1
    return reduce(DataFrame.union, out) if out else g.nodes.select("id", F.lit(0).cast("long").alias("level")).limit(0)


def triangles(g: Graph) -> DataFrame:
    """(a, b, c): 3-cliques; edges run from lower to higher degree, so hubs start few wedges."""
    u = undirected(local_edges(g.nodes, g.edges))
    degree = u.groupBy("x").agg(F.count("*").alias("k"))
    d = u.join(degree.toDF("x", "kx"), "x").join(degree.toDF("y", "ky"), "y").filter("kx < ky OR (kx = ky AND x < y)").select("x", "y")
    d = cut(d)
    found = d.toDF("p", "q").join(d.toDF("p", "r"), "p").filter("q <> r").join(d.toDF("q", "r"), ["q", "r"])
    sorted_ = F.sort_array(F.array("p", "q", "r"))
    return found.select(sorted_[0].alias("a"), sorted_[1].alias("b"), sorted_[2].alias("c")).distinct()


def subgraph_iso(g: Graph, kinds: list[str], k: int = 100) -> DataFrame:
    """(n1, n2, ...): undirected paths of distinct nodes with these kinds in order."""
    u = undirected(local_edges(g.nodes, g.edges))
    by_kind = g.nodes.select("id", "kind")
    out = by_kind.filter(F.col("kind") == kinds[0]).select(F.col("id").alias("n1"))
    for i, kind in enumerate(kinds[1:], 2):
        nxt = u.toDF(f"n{i - 1}", f"n{i}").join(by_kind.filter(F.col("kind") == kind).select(F.col("id").alias(f"n{i}")), f"n{i}", "left_semi")
        out = out.join(nxt, f"n{i - 1}")
        for j in range(1, i - 1):
            out = out.filter(F.col(f"n{j}") != F.col(f"n{i}"))
    names = [f"n{i}" for i in range(1, len(kinds) + 1)]
    return out.select(*names).orderBy(*names).limit(k)
