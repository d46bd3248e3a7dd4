"""Statistics, coupling, layers and health of a graph of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom import loops
from graphloom.graph import Graph, local_edges

ENTRY_NAMES = ("index", "main", "cli", "app", "server", "entry")


def top(df: DataFrame, score: str, k: int = 30, key: str = "id") -> DataFrame:
    return df.orderBy(F.col(score).desc(), F.col(key).asc()).limit(k)


def ladder(value: Column, steps: list[tuple[float, int]], rest: int) -> Column:
    """The points of the first limit that the value does not exceed."""
    out = None
    for limit, points in steps:
        out = F.when(value <= limit, points) if out is None else out.when(value <= limit, points)
    return out.otherwise(rest).cast("long")


def stats(g: Graph) -> DataFrame:
    """(section, name, n): totals, then nodes per kind."""
    totals = g.nodes.agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))
    edges = g.edges.agg(F.count("*").alias("edges"))
    wide = totals.select(F.expr("stack(2, 'files', files, 'lines', lines) AS (name, n)")).union(edges.select(F.lit("edges"), F.col("edges")))
    by_kind = g.nodes.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    return wide.select(F.lit("total").alias("section"), "name", "n").union(by_kind.select(F.lit("kind"), "name", "n"))


def trace(g: Graph, name: str) -> DataFrame:
    """(section, other): imports and importers of one node."""
    out = g.edges.filter(F.col("src") == name).select(F.lit("imports").alias("section"), F.col("dst").alias("other"))
    return out.union(g.edges.filter(F.col("dst") == name).select(F.lit("imported_by"), F.col("src")))


def blast_radius(g: Graph, name: str) -> DataFrame:
    """(id, depth): everything that reaches ``name``, itself excluded."""
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return loops.bfs(back, g.nodes.filter(F.col("id") == name)).filter("depth > 0")


def coupling(g: Graph, part: str) -> DataFrame:
    """(id, n): nodes with imports whose id contains ``part``."""
    return g.edges.filter(F.col("dst").contains(part)).groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n"))


def dead_files(g: Graph, entry_names: tuple[str, ...] = ENTRY_NAMES) -> DataFrame:
    """(id): nodes nobody imports whose base name is no entry point's."""
    base = F.regexp_extract("id", r"([^/]*?)(\.[^./]*)?$", 1)
    return g.nodes.join(g.edges.select(F.col("dst").alias("id")), "id", "left_anti").filter(~base.isin(*entry_names)).select("id")


def exports(nodes: DataFrame, k: int = 30) -> DataFrame:
    """(id, n): files by number of exports."""
    return top(nodes.select("id", F.size("exports").cast("long").alias("n")).filter("n > 0"), "n", k)


def hotspots(g: Graph, k: int = 30) -> DataFrame:
    """(id, n_out, n_in, total): nodes by degree; dangling imports count."""
    ends = g.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(g.edges.select("dst", F.lit(0), F.lit(1)))
    degree = ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in")).withColumn("total", F.col("n_out") + F.col("n_in"))
    return top(degree.join(g.nodes.select("id"), "id", "left_semi"), "total", k)


def size(g: Graph, k: int = 30) -> DataFrame:
    """(id, lines, pct): largest nodes with their share of all lines."""
    total = g.nodes.agg(F.sum("lines").alias("all"))
    return top(g.nodes.select("id", "lines"), "lines", k).join(F.broadcast(total)).select("id", "lines", F.round(F.col("lines") * 100.0 / F.col("all"), 4).alias("pct"))


def layers(g: Graph) -> DataFrame:
    """(id, depth): distance from the nodes that nobody imports; -1 where none reaches."""
    roots = g.nodes.select("id").join(g.edges.select(F.col("dst").alias("id")), "id", "left_anti")
    return g.nodes.select("id").join(loops.bfs(g.edges, roots), "id", "left").select("id", F.coalesce("depth", F.lit(-1)).alias("depth"))


def layer_violations(g: Graph, depths: DataFrame) -> DataFrame:
    """(src, dst, up): edges to a layer more than one above."""
    a = depths.select(F.col("id").alias("src"), F.col("depth").alias("ds"))
    b = depths.select(F.col("id").alias("dst"), F.col("depth").alias("dd"))
    return g.edges.join(a, "src").join(b, "dst").filter("dd >= 0 AND ds - dd > 1").select("src", "dst", (F.col("ds") - F.col("dd")).alias("up"))


def diff(g: Graph, changed: DataFrame) -> DataFrame:
    """(id, depth) of changed nodes (id) and everything that reaches them."""
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return loops.bfs(back, changed.join(g.nodes, "id", "left_semi"))


def orphan_exports(exported: DataFrame, edges: DataFrame, used: DataFrame) -> DataFrame:
    """(file, name) of ``exported`` that no importing file uses; ``used`` has (file, name)."""
    mine = exported.select("file", "name").distinct()
    # users of the same name first: all names of all importing files would be far more
    met = mine.join(used.select(F.col("file").alias("user"), "name").distinct(), "name")
    seen = met.join(edges.select(F.col("dst").alias("file"), F.col("src").alias("user")).distinct(), ["file", "user"], "left_semi").select("file", "name").distinct()
    return mine.join(seen, ["file", "name"], "left_anti")


def health(g: Graph, cycles: DataFrame, complex_share: DataFrame) -> DataFrame:
    """One row of four scores of 25 and a grade. ``cycles`` (n), ``complex_share`` (share) are single rows."""
    n = g.nodes.agg(F.count("*").alias("n"))
    ends = g.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(g.edges.select("dst", F.lit(0), F.lit(1)))
    degree = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    most = degree.join(g.nodes.select("id"), "id", "left_semi").agg(F.coalesce(F.max(F.col("o") + F.col("i")), F.lit(0)).alias("most"))
    dead = degree.filter("o > 0 AND i = 0 AND id IS NOT NULL").agg(F.count("*").alias("dead"))
    row = n.join(most).join(dead).join(cycles.select(F.col("n").alias("cycles"))).join(complex_share)
    c = F.col("cycles")
    points = {
        "cycle_score": F.when(c == 0, 25).when(c <= 2, 15).when(c <= 5, 8).otherwise(0).cast("long"),
        "coupling_score": ladder(F.col("most") / F.greatest(F.col("n") - 1, F.lit(1)), [(0.4, 25), (0.6, 20), (0.8, 15), (0.95, 8)], 0),
        "dead_score": ladder(F.col("dead") / F.greatest("n", F.lit(1)), [(0.05, 25), (0.1, 20), (0.2, 15), (0.35, 8)], 0),
        "complex_score": ladder(F.col("share"), [(0.05, 25), (0.1, 20), (0.2, 15), (0.35, 8)], 0),
    }
    out = row.select(*(v.alias(k) for k, v in points.items())).withColumn("score", sum(F.col(k) for k in points))
    s = F.col("score")
    return out.withColumn("grade", F.when(s >= 90, "A").when(s >= 80, "B").when(s >= 65, "C").when(s >= 50, "D").otherwise("F"))


def compare(a: Graph, b: Graph) -> DataFrame:
    """(status, n): ids added, removed and common from a to b."""
    both = a.nodes.select("id", F.lit(1).alias("a")).join(b.nodes.select("id", F.lit(1).alias("b")), "id", "full")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("common")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def coupling_delta(a: Graph, b: Graph, k: int = 20) -> DataFrame:
    """(id, delta): common nodes by change of degree."""
    degree = lambda g, name: g.edges.select(F.col("src").alias("id")).union(g.edges.select("dst")).groupBy("id").agg(F.count("*").alias(name))
    ids = a.nodes.select("id").join(b.nodes.select("id"), "id")
    out = ids.join(degree(a, "na"), "id", "left").join(degree(b, "nb"), "id", "left")
    out = out.select("id", (F.coalesce("nb", F.lit(0)) - F.coalesce("na", F.lit(0))).alias("delta")).filter("delta <> 0")
    return out.orderBy(F.abs("delta").desc(), "id").limit(k)


def context(files: DataFrame, budget: int) -> DataFrame:
    """(id, chars, used): the prefix of ranked headers (id, rank, chars) that fits a budget of tokens.

    Each header takes a character at least, so no more than the budget's characters of
    headers are summed up, whatever the number of files.
    """
    first = files.orderBy(F.col("rank").desc(), "id").limit(max(budget * 4, 0))
    w = Window.orderBy(F.col("rank").desc(), "id").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("used", F.sum(F.col("chars") + 1).over(w)).filter(F.col("used") <= budget * 4).select("id", "chars", "used")


def circular(g: Graph) -> DataFrame:
    """(component, n): strongly connected components of two or more nodes, which hold every cycle."""
    from graphloom.operators.paths import scc

    core = local_edges(g.nodes, loops.cyclic_core(g.edges))
    nodes = core.select(F.col("src").alias("id")).union(core.select("dst")).distinct()
    return scc(Graph(nodes, core)).groupBy("component").agg(F.count("*").alias("n")).filter("n > 1")
