"""Ranks by fixpoint iteration: each round is a join and a grouped sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, local_edges
from graphloom.session import cut

CUT_EACH = 4


def pagerank(g: Graph, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, rank): uniform start, dangling mass spread evenly, parallel edges counted."""
    edges = local_edges(g.nodes, g.edges)
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    weighted = cut(edges.groupBy("src", "dst").agg(F.count("*").alias("m")).join(out, "src").select("src", "dst", (F.col("m") / F.col("out")).alias("w")))
    n = g.nodes.count()
    nodes = cut(g.nodes.select("id").join(out.select(F.col("src").alias("id"), F.lit(True).alias("flows")), "id", "left"))
    rank = nodes.select("id", "flows", F.lit(1.0 / n).alias("r"))
    for i in range(rounds):
        flow = weighted.join(rank.select(F.col("id").alias("src"), "r"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("w")).alias("v"))
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("flows").isNull(), F.col("r"))), F.lit(0.0)).alias("lost"))
        rank = nodes.join(flow, "id", "left").join(F.broadcast(lost)).select("id", "flows", (F.lit((1 - damping) / n) + damping * F.col("lost") / n + damping * F.coalesce("v", F.lit(0.0))).alias("r"))
        if (i + 1) % CUT_EACH == 0:
            rank = cut(rank)
    return rank.select("id", F.col("r").alias("rank"))


def _normed(df: DataFrame, name: str) -> DataFrame:
    norm = df.agg(F.sqrt(F.sum(F.col(name) * F.col(name))).alias("norm"))
    return df.join(F.broadcast(norm)).select("id", F.when(F.col("norm") > 0, F.col(name) / F.col("norm")).otherwise(F.col(name)).alias(name))


def hits(g: Graph, rounds: int = 20) -> DataFrame:
    """(id, hub, authority): both sides updated from the old values, unit length each round."""
    e = cut(local_edges(g.nodes, g.edges))
    state = g.nodes.select("id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority"))
    for i in range(rounds):
        auth = e.join(state.select(F.col("id").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("a"))
        hub = e.join(state.select(F.col("id").alias("dst"), "authority"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("authority").alias("h"))
        new = g.nodes.select("id").join(auth, "id", "left").join(hub, "id", "left").fillna(0.0, ["a", "h"])
        norm = new.agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("na"), F.sqrt(F.sum(F.col("h") * F.col("h"))).alias("nh"))
        unit = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(F.col(x))
        state = new.join(F.broadcast(norm)).select("id", unit("h", "nh").alias("hub"), unit("a", "na").alias("authority"))
        if (i + 1) % 2 == 0:
            state = cut(state)
    return state


def power(g: Graph, rounds: int, alpha: float | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(id, score): eigenvector centrality over in-edges (alpha None), or Katz x = alpha A'x + 1."""
    e = cut(local_edges(g.nodes, g.edges))
    nodes = cut(g.nodes.select("id"))
    n = nodes.count()
    x = nodes.select("id", F.lit(1.0 / n if alpha is None else 1.0).alias("x"))
    for _ in range(rounds):
        flow = e.join(x.select(F.col("id").alias("src"), "x"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("v"))
        v = F.coalesce("v", F.lit(0.0))
        new = nodes.join(flow, "id", "left").select("id", (v if alpha is None else alpha * v + 1.0).alias("x"))
        new = cut(_normed(new, "x") if alpha is None else new)
        change = new.join(x.withColumnRenamed("x", "old"), "id").agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0]
        x = new
        if change is None or change < tolerance:
            break
    return (x if alpha is None else _normed(x, "x")).withColumnRenamed("x", "score")


def trophic(g: Graph, rounds: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """(id, score): 1 + the mean level of the in-neighbours, all updated at once.

    A node without in-neighbours has level 1 in every round, so rounds go over the others
    and the edges between them; what the first ones add is summed up once.
    """
    e = cut(local_edges(g.nodes, g.edges))
    moving = cut(e.groupBy(F.col("dst").alias("id")).agg(F.count("*").cast("double").alias("n")))
    inner = cut(e.join(moving.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst"))
    # in-neighbours of level 1
    fixed = moving.join(inner.groupBy(F.col("dst").alias("id")).agg(F.count("*").cast("double").alias("m")), "id", "left")
    base = cut(fixed.select("id", "n", (F.col("n") - F.coalesce("m", F.lit(0.0))).alias("one")))
    level = base.select("id", F.lit(1.0).alias("x"))
    for _ in range(rounds):
        flow = inner.join(level.select(F.col("id").alias("src"), "x"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("s"))
        new = cut(base.join(flow, "id", "left").select("id", (1.0 + (F.col("one") + F.coalesce("s", F.lit(0.0))) / F.col("n")).alias("x")))
        change = new.join(level.withColumnRenamed("x", "old"), "id").agg(F.max(F.abs(F.col("x") - F.col("old")))).first()[0]
        level = new
        if change is None or change < tolerance:
            break
    return g.nodes.select("id").join(level, "id", "left").select("id", F.coalesce("x", F.lit(1.0)).alias("score"))


def voterank(g: Graph, k: int = 30) -> DataFrame:
    """(round, id, votes): elected nodes lose their votes, their neighbours 1 / mean degree of theirs."""
    from graphloom.graph import undirected

    u = cut(undirected(local_edges(g.nodes, g.edges)))
    n = g.nodes.count()
    mean = max(u.count() / n, 1e-9) if n else 1.0
    power_ = cut(g.nodes.select("id", F.lit(1.0).alias("p")))
    elected: list[tuple[int, str, float]] = []
    for i in range(min(k, n)):
        votes = u.join(power_.select(F.col("id").alias("y"), "p"), "y").groupBy(F.col("x").alias("id")).agg(F.round(F.sum("p"), 9).alias("v"))
        best = votes.filter(~F.col("id").isin([e[1] for e in elected]) if elected else F.lit(True)).orderBy(F.col("v").desc(), "id").first()
        if best is None or best["v"] <= 0:
            break
        elected.append((i, best["id"], best["v"]))
        near = u.filter(F.col("x") == best["id"]).select(F.col("y").alias("id"), F.lit(1.0 / mean).alias("loss"))
        lost = power_.join(near, "id", "left").select("id", F.when(F.col("id") == best["id"], 0.0).otherwise(F.greatest(F.lit(0.0), F.col("p") - F.coalesce("loss", F.lit(0.0)))).alias("p"))
        power_ = cut(lost)
    return g.nodes.sparkSession.createDataFrame(elected, "round long, id string, votes double")
