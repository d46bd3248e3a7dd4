"""Nodes that hold a graph together: articulation points and dominators.

Leaves are stripped in rounds over DataFrames, which settles tree-like parts; what is left
is walked once, one connected component a task, in time linear in its edges. A component
without its trees must fit a task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import loops
from graphloom.graph import Graph, local_edges, undirected
from graphloom.operators.analysis import top
from graphloom.session import cut

STRIP_ROUNDS = 12


def _numbered(pairs: pd.DataFrame) -> tuple[list[str], list[list[int]]]:
    """Ids in ascending order, and the places that each one's pairs (x, y) lead to, ascending."""
    names = sorted(set(pairs["x"]) | set(pairs["y"]))
    place = {n: i for i, n in enumerate(names)}
    out: list[list[int]] = [[] for _ in names]
    for x, y in zip(pairs["x"], pairs["y"], strict=True):
        out[place[x]].append(place[y])
    return names, [sorted(set(o)) for o in out]


def cut_nodes(near: list[list[int]]) -> set[int]:
    """Nodes without which an undirected graph has more components."""
    entered, reach, found = [-1] * len(near), [0] * len(near), set()
    clock = 0
    for root in range(len(near)):
        if entered[root] >= 0:
            continue
        entered[root] = reach[root] = clock
        clock += 1
        branches, walk = 0, [(root, -1, iter(near[root]))]
        while walk:
            x, parent, rest = walk[-1]
            y = next((y for y in rest if y != parent), None)
            if y is None:
                walk.pop()
                if parent >= 0:
                    reach[parent] = min(reach[parent], reach[x])
                    if parent == root:
                        branches += 1
                    elif reach[x] >= entered[parent]:
                        found.add(parent)
            elif entered[y] >= 0:
                reach[x] = min(reach[x], entered[y])
            else:
                entered[y] = reach[y] = clock
                clock += 1
                walk.append((y, x, iter(near[y])))
        if branches > 1:
            found.add(root)
    return found


def articulation_points(g: Graph, k: int = 30) -> DataFrame:
    """(id, degree): nodes whose removal splits their component, by number of edges."""
    pairs = cut(undirected(local_edges(g.nodes, g.edges)))
    found: list[DataFrame] = []
    for _ in range(STRIP_ROUNDS):
        degree = pairs.groupBy("x").agg(F.count("*").alias("n"))
        leaves = cut(degree.filter("n = 1").select("x"))
        if leaves.isEmpty():
            break
        # what a leaf hangs on splits it off, if there is anything else
        found.append(cut(pairs.join(leaves, "x").select(F.col("y").alias("x")).distinct().join(degree.filter("n > 1"), "x").select(F.col("x").alias("id"))))
        pairs = cut(pairs.join(leaves, "x", "left_anti").join(leaves.withColumnRenamed("x", "y"), "y", "left_anti").select("x", "y"))
    core = loops.components(pairs.toDF("src", "dst"), pairs.select(F.col("x").alias("id")).distinct())

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        names, near = _numbered(part)
        return pd.DataFrame({"id": [names[i] for i in sorted(cut_nodes(near))]}, dtype=object)

    out = pairs.join(core.toDF("x", "label"), "x").groupBy("label").applyInPandas(walk, "id string")
    for f in found:
        out = out.union(f)
    ends = g.edges.select(F.col("src").alias("id")).union(g.edges.select("dst")).groupBy("id").agg(F.count("*").alias("degree"))
    return top(out.distinct().join(ends, "id").select("id", "degree"), "degree", k)


def immediate_dominators(out: list[list[int]], entry: int) -> list[int]:
    """For each node the nearest one that all paths from the entry pass; -1 where unreachable, the entry its own."""
    order, state, walk = [], [0] * len(out), [(entry, iter(out[entry]))]
    state[entry] = 1
    while walk:
        x, rest = walk[-1]
        y = next((y for y in rest if not state[y]), None)
        if y is None:
            order.append(walk.pop()[0])
        else:
            state[y] = 1
            walk.append((y, iter(out[y])))
    rank = {x: i for i, x in enumerate(order)}  # the entry last
    into: dict[int, list[int]] = {x: [] for x in order}
    for x in order:
        for y in out[x]:
            into[y].append(x)
    best = [-1] * len(out)
    best[entry] = entry
    changed = True
    while changed:
        changed = False
        for x in reversed(order[:-1]):
            known = [p for p in into[x] if best[p] >= 0]
            a = known[0]
            for b in known[1:]:
                while a != b:  # the lower one moves up until both meet
                    if rank[a] < rank[b]:
                        a = best[a]
                    else:
                        b = best[b]
            changed |= best[x] != a
            best[x] = a
    return best


def dominator_tree(g: Graph, entry: str | None = None) -> DataFrame:
    """(id, idom) of the nodes that the entry reaches, itself left out.

    Without an entry it is the node that nothing leads to with most edges out. What the
    entry reaches is found over DataFrames and walked in one task, which it must fit.
    """
    edges = local_edges(g.nodes, g.edges).filter("src <> dst").distinct()
    if entry is None:
        starts = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).join(edges.select(F.col("dst").alias("id")), "id", "left_anti")
        seed = starts.orderBy(F.col("n").desc(), "id").limit(1).select("id")
    else:
        seed = g.nodes.filter(F.col("id") == entry).select("id")
    seed = cut(seed)
    reached = loops.bfs(edges, seed).select(F.col("id").alias("src"))
    inner = edges.join(reached, "src").select(F.col("src").alias("x"), F.col("dst").alias("y"), F.lit(False).alias("start"))
    rows = inner.union(seed.select("id", F.col("id").alias("y"), F.lit(True)))

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        names, out = _numbered(part)
        first = names.index(part.loc[part["start"], "x"].iloc[0])
        best = immediate_dominators(out, first)
        kept = [i for i, b in enumerate(best) if b >= 0 and i != first]
        return pd.DataFrame({"id": [names[i] for i in kept], "idom": [names[best[i]] for i in kept]}, dtype=object)

    return rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(walk, "id string, idom string")
