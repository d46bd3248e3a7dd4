"""Communities and cohesion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom import loops
from graphloom.graph import Graph, local_edges, undirected
from graphloom.operators.paths import triangles
from graphloom.session import cut


def islands(g: Graph) -> DataFrame:
    """(label, n): connected components, largest first."""
    found = loops.stripped_components(local_edges(g.nodes, g.edges), g.nodes)
    return found.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "label")


def label_propagation(g: Graph, rounds: int = 15) -> DataFrame:
    """(id, label): every node takes the label most of its neighbours have, the smallest of several."""
    u = cut(undirected(local_edges(g.nodes, g.edges)))
    state = g.nodes.select("id", F.col("id").alias("label"))
    best = Window.partitionBy("x").orderBy(F.col("n").desc(), "label")
    for _ in range(rounds):
        votes = u.join(state.toDF("y", "label"), "y").groupBy("x", "label").agg(F.count("*").alias("n"))
        # a node's own label counts once, which keeps two-sided graphs from swapping labels forever
        own = state.select(F.col("id").alias("x"), "label", F.lit(1).cast("long").alias("n"))
        votes = votes.unionByName(own).groupBy("x", "label").agg(F.sum("n").alias("n"))
        new = cut(votes.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select(F.col("x").alias("id"), "label"))
        changed = new.join(state.toDF("id", "old"), "id").filter("label <> old").isEmpty()
        state = new
        if changed:
            break
    return state


def k_core(g: Graph) -> DataFrame:
    """(id, core): the largest k for which a node stays when nodes of lower degree are removed."""
    u = cut(undirected(local_edges(g.nodes, g.edges)))
    left, k, parts = cut(g.nodes.select("id")), 0, []
    while not left.isEmpty():
        while True:
            degree = u.groupBy(F.col("x").alias("id")).agg(F.count("*").alias("n"))
            low = cut(left.join(degree, "id", "left").filter(F.coalesce("n", F.lit(0)) <= k).select("id"))
            if low.isEmpty():
                break
            parts.append(low.withColumn("core", F.lit(k).cast("long")))
            left = cut(left.join(low, "id", "left_anti"))
            u = cut(u.join(low.withColumnRenamed("id", "x"), "x", "left_anti").join(low.withColumnRenamed("id", "y"), "y", "left_anti").select("x", "y"))
        k += 1
    out = parts[0] if parts else left.withColumn("core", F.lit(0).cast("long"))
    for p in parts[1:]:
        out = out.union(p)
    return out


def triangle_communities(g: Graph) -> DataFrame:
    """(id, community): 3-clique percolation: triangles that share an edge belong together."""
    t = cut(triangles(g).withColumn("t", F.concat_ws("|", "a", "b", "c")))
    sides = t.select("t", F.explode(F.array(F.concat_ws("|", "a", "b"), F.concat_ws("|", "a", "c"), F.concat_ws("|", "b", "c"))).alias("side"))
    # a star per side instead of all its pairs of triangles
    least = sides.groupBy("side").agg(F.min("t").alias("hub"))
    links = sides.join(least, "side").select(F.col("hub").alias("src"), F.col("t").alias("dst"))
    label = loops.components(links, t.select(F.col("t").alias("id"))).toDF("t", "community")
    return t.join(label, "t").select(F.explode(F.array("a", "b", "c")).alias("id"), "community").distinct()


def modularity(g: Graph, labels: DataFrame) -> DataFrame:
    """One row (q): modularity of a labelling (id, label) of the undirected graph."""
    u = undirected(local_edges(g.nodes, g.edges))
    a, b = labels.toDF("x", "lx"), labels.toDF("y", "ly")
    m2 = u.agg(F.count("*").alias("m2"))
    inside = u.join(a, "x").join(b, "y").agg(F.count_if(F.col("lx") == F.col("ly")).alias("inside"))
    degree = u.join(a, "x").groupBy("lx").agg(F.count("*").cast("double").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return m2.join(inside).join(degree).select(F.round(F.col("inside") / F.col("m2") - F.col("dd") / (F.col("m2") * F.col("m2")), 6).alias("q"))
