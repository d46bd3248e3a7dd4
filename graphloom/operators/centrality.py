"""Centralities. Path-based ones share one table of shortest paths per source.

That table has a row for each (source, reached node), so they are meant for a subgraph
of some kinds; the work is joins and grouped sums, not memory of one machine.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import loops
from graphloom.graph import Graph, local_edges, undirected
from graphloom.session import cut


def _pairs(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Local edges and the shortest-path table (s, v, d, sigma)."""
    e = cut(local_edges(g.nodes, g.edges))
    return e, cut(loops.shortest(e, g.nodes))


def _backward(g: Graph, e: DataFrame, sp: DataFrame, share: str, unit: str) -> DataFrame:
    """Dependencies (s, v, delta) from the farthest level inwards.

    ``share`` is what a predecessor gets of a node's (``unit`` + delta), in terms of
    sigma (of the predecessor), sigma_w and preds (number of edges into w on shortest paths).
    """
    down = sp.select("s", F.col("v").alias("src"), F.col("d").alias("dv"), "sigma").join(e, "src")
    up = sp.select("s", F.col("v").alias("dst"), F.col("d").alias("dw"), F.col("sigma").alias("sigma_w"))
    dag = down.join(up, ["s", "dst"]).filter("dw = dv + 1")
    preds = dag.groupBy("s", "dst").agg(F.count("*").alias("preds"))
    dag = cut(dag.join(preds, ["s", "dst"]))
    depth = sp.agg(F.max("d")).first()[0] or 0
    done = [sp.filter(F.col("d") == depth).select("s", "v", F.lit(0.0).alias("delta"))]
    for level in range(depth, 0, -1):
        step = dag.filter(F.col("dw") == level).join(done[-1].select("s", F.col("v").alias("dst"), "delta"), ["s", "dst"])
        gain = step.groupBy("s", F.col("src").alias("v")).agg(F.sum(F.expr(f"{share} * ({unit} + delta)")).alias("gain"))
        here = sp.filter(F.col("d") == level - 1).select("s", "v").join(gain, ["s", "v"], "left")
        done.append(cut(here.select("s", "v", F.coalesce("gain", F.lit(0.0)).alias("delta"))))
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.filter("s <> v")


def _summed(g: Graph, parts: DataFrame, name: str, scale: float) -> DataFrame:
    total = parts.groupBy(F.col("v").alias("id")).agg(F.sum(name).alias("t"))
    return g.nodes.select("id").join(total, "id", "left").select("id", F.round(F.coalesce("t", F.lit(0.0)) * scale, 6).alias("score"))


def _scale(n: int) -> float:
    return 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0


def betweenness(g: Graph) -> DataFrame:
    """(id, score): share of shortest paths through a node; parallel edges are paths of their own."""
    e, sp = _pairs(g)
    return _summed(g, _backward(g, e, sp, "sigma / sigma_w", "1.0"), "delta", _scale(g.nodes.count()))


def load(g: Graph) -> DataFrame:
    """(id, score): a unit of load from each reached node, split evenly over predecessors."""
    e, sp = _pairs(g)
    return _summed(g, _backward(g, e, sp, "1.0 / preds", "1.0"), "delta", _scale(g.nodes.count()))


def percolation(g: Graph) -> DataFrame:
    """(id, score): betweenness dependencies weighted by degree(s) / max(1, sum of degrees - degree(v))."""
    e, sp = _pairs(g)
    degree = cut(e.select(F.col("src").alias("id")).union(e.select("dst")).groupBy("id").agg(F.count("*").cast("double").alias("deg")))
    total = degree.agg(F.sum("deg")).first()[0] or 0.0
    parts = _backward(g, e, sp, "sigma / sigma_w", "1.0")
    parts = parts.join(degree.select(F.col("id").alias("s"), F.col("deg").alias("ds")), "s").join(degree.select(F.col("id").alias("v"), F.col("deg").alias("dv")), "v", "left")
    weighted = parts.select("v", (F.col("delta") * F.col("ds") / F.greatest(F.lit(1.0), F.lit(total) - F.coalesce("dv", F.lit(0.0)))).alias("w"))
    return _summed(g, weighted, "w", 1.0)


def closeness(g: Graph) -> DataFrame:
    """(id, score): reached / total distance * reached / (n - 1)."""
    _, sp = _pairs(g)
    n = g.nodes.count()
    per = sp.filter("d > 0").groupBy(F.col("s").alias("id")).agg(F.count("*").alias("r"), F.sum("d").alias("t"))
    score = F.col("r") / F.col("t") * F.col("r") / max(n - 1, 1)
    return g.nodes.select("id").join(per, "id", "left").select("id", F.round(F.coalesce(score, F.lit(0.0)), 6).alias("score"))


def harmonic(g: Graph) -> DataFrame:
    """(id, score): sum of 1 / distance, over n - 1."""
    _, sp = _pairs(g)
    n = g.nodes.count()
    return _summed(g, sp.filter("d > 0").select(F.col("s").alias("v"), (1.0 / F.col("d")).alias("h")), "h", 1.0 / max(n - 1, 1))


def reaching(g: Graph) -> DataFrame:
    """(id, score): share of the other nodes that are reachable."""
    _, sp = _pairs(g)
    n = g.nodes.count()
    return _summed(g, sp.filter("d > 0").select(F.col("s").alias("v"), F.lit(1.0).alias("h")), "h", 1.0 / max(n - 1, 1))


def current_flow(g: Graph) -> DataFrame:
    """(id, score): for how many ordered pairs a node lies inside some shortest path."""
    _, sp = _pairs(g)
    a = sp.select("s", "v", F.col("d").alias("d1")).filter("s <> v")
    b = sp.select(F.col("s").alias("v"), F.col("v").alias("t"), F.col("d").alias("d2")).filter("v <> t")
    whole = sp.select("s", F.col("v").alias("t"), "d").filter("s <> t")
    inside = a.join(b, "v").join(whole, ["s", "t"]).filter("d1 + d2 = d")
    return _summed(g, inside.select("v", F.lit(1.0).alias("one")), "one", 1.0)


def subgraph_centrality(g: Graph, length: int = 10) -> DataFrame:
    """(id, score): 1 + closed undirected walks of k steps / k!, for k up to ``length``."""
    u = cut(undirected(local_edges(g.nodes, g.edges)))
    walk = g.nodes.select(F.col("id").alias("s"), F.col("id").alias("x"), F.lit(1.0).alias("c"))
    parts = []
    for k in range(1, length + 1):
        walk = cut(walk.join(u, "x").groupBy("s", F.col("y").alias("x")).agg(F.sum("c").alias("c")))
        parts.append(walk.filter("s = x").select(F.col("s").alias("v"), (F.col("c") / math.factorial(k)).alias("w")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return _summed(g, out.union(g.nodes.select("id", F.lit(1.0))), "w", 1.0)


def structural_holes(g: Graph) -> DataFrame:
    """(id, effective, constraint): Burt's effective size and constraint."""
    u = cut(undirected(local_edges(g.nodes, g.edges)))
    k = u.groupBy("x").agg(F.count("*").alias("k"))
    a, b, c = u.toDF("v", "u"), u.toDF("u", "w"), u.toDF("v", "w")
    ties = a.join(b, "u").join(c, ["v", "w"]).groupBy("v", "u").agg(F.count("*").alias("common"))
    share = a.join(k.select(F.col("x").alias("v"), (1.0 / F.col("k")).alias("p")), "v")
    via = share.select("v", F.col("u").alias("w"), F.col("p").alias("p1")).join(share.select(F.col("v").alias("w"), "u", F.col("p").alias("p2")), "w").filter("u <> v")
    indirect = via.groupBy("v", "u").agg(F.sum(F.col("p1") * F.col("p2")).alias("q"))
    row = share.join(ties, ["v", "u"], "left").join(indirect, ["v", "u"], "left").fillna(0, ["common"]).fillna(0.0, ["q"])
    per = row.groupBy(F.col("v").alias("id")).agg(
        F.round(F.count("*") - F.sum(F.col("common") * F.col("p")), 6).alias("effective"),
        F.round(F.sum((F.col("p") + F.col("q")) * (F.col("p") + F.col("q"))), 6).alias("constraint"),
    )
    return per.join(g.nodes.select("id"), "id", "left_semi")


def dispersion(g: Graph) -> DataFrame:
    """(id, n): pairs of neighbours that are neither adjacent nor share a third neighbour."""
    u = cut(undirected(local_edges(g.nodes, g.edges)))
    wedge = u.toDF("a", "v").join(u.toDF("v", "b"), "v").filter("a < b").select("v", "a", "b")
    open_ = wedge.join(u.toDF("a", "b"), ["a", "b"], "left_anti")
    other = wedge.select(F.col("v").alias("w"), "a", "b")
    shared = open_.join(other, ["a", "b"]).filter("w <> v").select("v", "a", "b").distinct()
    return open_.join(shared, ["v", "a", "b"], "left_anti").groupBy(F.col("v").alias("id")).agg(F.count("*").alias("n"))


def group(g: Graph, kind: str) -> DataFrame:
    """One row (members, reached, share, cohesion): outside neighbours of a kind, and its inner edges' share of all possible."""
    u = undirected(local_edges(g.nodes, g.edges))
    own = g.nodes.filter(F.col("kind") == kind).select("id")
    inside, outside = own.withColumnRenamed("id", "x"), own.withColumnRenamed("id", "y")
    reached = u.join(inside, "x", "left_semi").join(outside, "y", "left_anti").agg(F.countDistinct("y").alias("reached"))
    inner = u.join(inside, "x", "left_semi").join(outside, "y", "left_semi").agg(F.count("*").alias("inner"))
    n = g.nodes.agg(F.count("*").alias("n"), F.count_if(F.col("kind") == kind).alias("members"))
    return n.join(reached).join(inner).select(
        "members",
        "reached",
        F.round(F.col("reached") / F.greatest(F.col("n") - F.col("members"), F.lit(1)), 6).alias("share"),
        F.round(F.col("inner") / F.greatest(F.col("members") * (F.col("members") - 1), F.lit(1)), 6).alias("cohesion"),
    )


def _walks(g: Graph, walks: int, steps: int, seed: int) -> DataFrame:
    """Seeded walks (s, walk, step, x) over undirected neighbours, chosen by hash: the same on any cluster."""
    u = undirected(local_edges(g.nodes, g.edges)).groupBy("x").agg(F.sort_array(F.collect_list("y")).alias("near"))
    u = cut(u)
    at = g.nodes.select(F.col("id").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk")).withColumn("x", F.col("s"))
    out = []
    for step in range(1, steps + 1):
        pick = F.pmod(F.xxhash64("s", "walk", F.lit(step), F.lit(seed)), F.size("near")).cast("int") + 1
        at = cut(at.join(u, "x").select("s", "walk", F.element_at("near", pick).alias("x")))
        out.append(at.withColumn("step", F.lit(step)))
    frame = out[0]
    for o in out[1:]:
        frame = frame.union(o)
    return frame


def second_order(g: Graph, walks: int = 50, steps: int = 50, seed: int = 0xC0DE) -> DataFrame:
    """(id, score): 1 / variance of the return times of seeded random walks."""
    first = _walks(g, walks, steps, seed).filter("x = s").groupBy("s", "walk").agg(F.min("step").alias("t"))
    per = first.groupBy(F.col("s").alias("id")).agg(F.var_pop("t").alias("var"))
    return g.nodes.select("id").join(per, "id", "left").select("id", F.round(F.when(F.col("var") > 0, 1 / F.col("var")).otherwise(0.0), 6).alias("score"))


def current_flow_closeness(g: Graph, walks: int = 30, steps: int = 50, seed: int = 0x0BAD) -> DataFrame:
    """(id, score): hits over summed hitting times of seeded random walks to all other nodes."""
    hit = _walks(g, walks, steps, seed).filter("x <> s").groupBy("s", "walk", "x").agg(F.min("step").alias("t"))
    per = hit.groupBy(F.col("s").alias("id")).agg(F.count("*").alias("n"), F.sum("t").alias("t"))
    return g.nodes.select("id").join(per, "id", "left").select("id", F.round(F.coalesce(F.col("n") / F.col("t"), F.lit(0.0)), 6).alias("score"))
