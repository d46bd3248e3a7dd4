"""Flows, maximal cliques, Steiner trees and feedback arcs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import loops
from graphloom.graph import Graph, local_edges, undirected
from graphloom.operators.paths import scc, triangles
from graphloom.session import cut


def _path(edges: DataFrame, a: str, b: str) -> list[tuple[str, str]]:
    """The edges of one shortest path from a to b, each node entered from its smallest predecessor; none: empty."""
    spark = edges.sparkSession
    layers = [cut(spark.createDataFrame([(a, None)], "id string, parent string"))]
    while True:
        seen = reduce(DataFrame.union, layers).select("id")
        new = edges.join(layers[-1].select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        new = cut(new.join(seen, "id", "left_anti"))
        if new.isEmpty():
            return []
        layers.append(new)
        if not new.filter(F.col("id") == b).isEmpty():
            break
    # one row with the nodes of the path, found layer by layer from its end
    way = layers[-1].filter(F.col("id") == b).select(F.array("parent", "id").alias("way"))
    for layer in reversed(layers[1:-1]):
        way = way.join(layer, F.col("way")[0] == F.col("id")).select(F.concat(F.array("parent"), "way").alias("way"))
    nodes = way.first()["way"]
    return list(zip(nodes, nodes[1:], strict=False))


def max_flow(g: Graph, a: str, b: str) -> DataFrame:
    """One row (source, target, flow): the number of edge-disjoint paths from a to b.

    Paths are sought in the residual graph by breadth; only the edges of one path a round
    reach the driver. Equal ends and unknown ends have flow 0.
    """
    spark = g.nodes.sparkSession
    left = cut(local_edges(g.nodes, g.edges).filter("src <> dst").distinct().withColumn("cap", F.lit(1).cast("long")))
    flow = 0
    while a != b:
        found = _path(left.select("src", "dst"), a, b)
        if not found:
            break
        flow += 1
        turned = [(x, y, -1) for x, y in found] + [(y, x, 1) for x, y in found]
        change = spark.createDataFrame(turned, "src string, dst string, cap long")
        left = cut(left.union(change).groupBy("src", "dst").agg(F.sum("cap").alias("cap")).filter("cap > 0"))
    return spark.createDataFrame([(a, b, flow)], "source string, target string, flow long")


def grow_cliques(near: dict[str, set[str]], first: set[str], later: set[str], earlier: set[str]) -> Iterator[set[str]]:
    """Maximal cliques that hold ``first``, more members out of ``later`` and none of ``earlier`` (pivoting by most neighbours)."""
    if not later:
        if not earlier:
            yield first
        return
    pivot = max(sorted(later | earlier), key=lambda v: len(near[v] & later))
    later, earlier = set(later), set(earlier)
    for v in sorted(later - near[pivot]):
        yield from grow_cliques(near, first | {v}, later & near[v], earlier & near[v])
        later.discard(v)
        earlier.add(v)


def maximal_cliques(g: Graph, least: int = 3) -> DataFrame:
    """(members, size): every maximal clique of three or more nodes once, members ascending, joined by commas.

    Triangles are found by joins; each node is then sent the triangles it is in and grows
    the cliques in which it comes first, nodes of few triangles first. A node's triangles
    must fit a task.
    """
    t = cut(triangles(g))
    corners = t.select("a", "b", "c").union(t.select("b", "a", "c")).union(t.select("c", "a", "b")).toDF("v", "p", "q")
    n = cut(corners.groupBy("v").agg(F.count("*").alias("n")))
    rows = corners.join(n.toDF("v", "nv"), "v").join(n.toDF("p", "np"), "p").join(n.toDF("q", "nq"), "q")

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        v, place = part["v"].iloc[0], (part["nv"].iloc[0], part["v"].iloc[0])
        near: dict[str, set[str]] = {}
        later: set[str] = set()
        for p, q, m, k in part[["p", "q", "np", "nq"]].itertuples(index=False):
            near.setdefault(p, set()).add(q)
            near.setdefault(q, set()).add(p)
            later |= {x for x, c in ((p, m), (q, k)) if (c, x) > place}
        found = [c for c in grow_cliques(near, {v}, later, set(near) - later) if len(c) >= least]
        return pd.DataFrame([(",".join(sorted(c)), len(c)) for c in found], columns=["members", "size"], dtype=object)

    return rows.groupBy("v").applyInPandas(grow, "members string, size long")


def clique_communities(g: Graph, k: int = 3) -> DataFrame:
    """(id, community): maximal cliques of k or more nodes belong together when they share k - 1."""
    cliques = cut(maximal_cliques(g, max(k, 3)).select("members"))

    def faces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for whole in part["members"]:
                yield pd.DataFrame({"face": [",".join(c) for c in combinations(whole.split(","), k - 1)], "members": whole}, dtype=object)

    shared = cut(cliques.mapInPandas(faces, "face string, members string"))
    hubs = shared.groupBy("face").agg(F.min("members").alias("src"))
    label = loops.components(shared.join(hubs, "face").select("src", F.col("members").alias("dst")), cliques.select(F.col("members").alias("id")))
    return label.select(F.explode(F.split("id", ",")).alias("node"), F.col("label").alias("community")).distinct().withColumnRenamed("node", "id")


def steiner(g: Graph, terminals: list[str]) -> DataFrame:
    """(x, y): edges of a tree over the terminals, at most twice as many as the best one has.

    Distances between terminals give a minimum spanning tree on the driver, whose size the
    argument bounds; its edges are then replaced by shortest paths, walked back over
    DataFrames. Terminals without a path between them get trees of their own.
    """
    spark = g.nodes.sparkSession
    ends = spark.createDataFrame([(t,) for t in sorted(set(terminals))], "id string").join(g.nodes.select("id"), "id", "left_semi")
    pairs = cut(undirected(local_edges(g.nodes, g.edges)))
    far = cut(loops.shortest(pairs.toDF("src", "dst"), ends).select("s", "v", "d"))
    between = far.join(ends.withColumnRenamed("id", "v"), "v", "left_semi").filter("s < v").orderBy("d", "s", "v").collect()
    tree: list[tuple[str, str, int]] = []
    group = {t: t for t in terminals}
    for r in between:
        old, new = group[r.v], group[r.s]
        if old != new:
            tree.append((r.s, r.v, r.d))
            group = {t: new if c == old else c for t, c in group.items()}
    at = spark.createDataFrame(tree, "s string, v string, d long")
    out = pairs.limit(0)
    for d in range(max((t[2] for t in tree), default=0), 0, -1):
        here = at.filter(F.col("d") == d)
        before = far.filter(F.col("d") == d - 1).select("s", F.col("v").alias("y"))
        step = here.join(pairs.toDF("v", "y"), "v").join(before, ["s", "y"]).groupBy("s", "v").agg(F.min("y").alias("y"))
        step = cut(step)
        out = out.union(step.select(F.least("v", "y"), F.greatest("v", "y")))
        at = at.filter(F.col("d") < d).union(step.select("s", F.col("y").alias("v"), F.lit(d - 1).cast("long")))
    return out.distinct()


def back_edges(out: dict[str, list[str]]) -> list[tuple[str, str]]:
    """Edges that lead to a node still being walked, in a walk by depth from the smallest id, neighbours ascending."""
    found, state = [], dict.fromkeys(out, 0)
    for root in sorted(out):
        if state[root]:
            continue
        state[root], walk = 1, [(root, iter(out[root]))]
        while walk:
            x, rest = walk[-1]
            y = next(rest, None)
            if y is None:
                state[x] = 2
                walk.pop()
            elif state[y] == 1:
                found.append((x, y))
            elif not state[y]:
                state[y] = 1
                walk.append((y, iter(out[y])))
    return found


def feedback_arcs(g: Graph) -> DataFrame:
    """(src, dst): edges without which no cycle is left; self loops among them.

    Only edges within a strongly connected component can lie on a cycle, so each component
    is walked in a task of its own, which it must fit.
    """
    edges = cut(local_edges(g.nodes, g.edges).distinct())
    part = cut(scc(g))
    inner = edges.filter("src <> dst").join(part.toDF("src", "component"), "src").join(part.toDF("dst", "other"), "dst").filter("component = other")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[str]] = {x: [] for x in set(rows["src"]) | set(rows["dst"])}
        for x, y in rows[["src", "dst"]].sort_values(["src", "dst"]).itertuples(index=False):
            out[x].append(y)
        return pd.DataFrame(back_edges(out), columns=["src", "dst"], dtype=object)

    return inner.select("component", "src", "dst").groupBy("component").applyInPandas(walk, "src string, dst string").union(edges.filter("src = dst"))
