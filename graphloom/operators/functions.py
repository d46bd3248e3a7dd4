"""Function tables and change history.

``functions``: file, name, start_line, end_line, is_exported, n_params; ``calls``: file,
name, callee; ``commits``: commit, ts, file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom import loops
from graphloom.graph import Graph
from graphloom.operators.analysis import ladder


def _last_segment(name: str):
    return F.regexp_extract(name, r"([^.:]*)$", 1)


def call_graph(functions: DataFrame, calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, name, target, callee): calls of functions exported by an imported file or the same one."""
    exported = functions.filter("is_exported").select(F.col("file").alias("target"), F.col("name").alias("callee")).distinct()
    met = calls.select("file", "name", "callee").distinct().join(exported, "callee")
    linked = edges.select(F.col("src").alias("file"), F.col("dst").alias("target")).distinct()
    return met.filter("file = target").unionByName(met.filter("file <> target").join(linked, ["file", "target"], "left_semi")).select("file", "name", "target", "callee")


def _members(groups: DataFrame) -> DataFrame:
    """Groups (id, k, ...) with ``all``: every group of an id in more than one, else null."""
    many = groups.groupBy("id").agg(F.array_sort(F.collect_set("k")).alias("all")).select("id", F.when(F.size("all") > 1, F.col("all")).alias("all"))
    return groups.filter("k IS NOT NULL").distinct().join(many, "id")


def _once(a: str, b: str, k: str):
    """Whether ``k`` is the first group that two ids share, so that a pair is met once."""
    return F.coalesce(F.array_min(F.array_intersect(a, b)) == F.col(k), F.lit(True))


def call_graph_of_groups(functions: DataFrame, calls: DataFrame, groups: DataFrame) -> DataFrame:
    """(file, name, target, callee) like ``call_graph`` where the files (id) of a group (k) import each other.

    Name and group are one join key, so neither the pairs of files of a group nor the calls
    of what other groups export are formed.
    """
    member = _members(groups.select("id", "k"))
    # a file in no group is one of its own
    key = F.coalesce(F.concat(F.lit("g"), F.col("k").cast("string")), F.concat(F.lit("f"), F.col("id")))
    exported = functions.filter("is_exported").select(F.col("file").alias("id"), F.col("name").alias("callee")).distinct().join(member, "id", "left")
    exported = exported.select("callee", key.alias("key"), F.col("id").alias("target"), F.col("k").alias("shared"), F.col("all").alias("b"))
    used = calls.select(F.col("file").alias("id"), "name", "callee").join(member, "id", "left").select("callee", key.alias("key"), F.col("id").alias("file"), "name", F.col("all").alias("a"))
    met = used.join(exported, ["callee", "key"]).filter(_once("a", "b", "shared"))
    # the key stays in, so that what lies together by it is made distinct in place
    return met.select("callee", "key", "file", "name", "target").distinct().select("file", "name", "target", "callee")


def dead_functions(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(file, name): exported functions that no other file calls by name or last segment."""
    names = calls.select(F.col("file").alias("user"), F.explode(F.array_distinct(F.array("callee", _last_segment("callee")))).alias("name"))
    return unused_exports(functions.filter("is_exported"), names)


def unused_exports(exported: DataFrame, names: DataFrame) -> DataFrame:
    """(file, name) of ``exported`` that no other file uses; ``names`` has (user, name), in any number."""
    exported = exported.select("file", "name").distinct()
    # users per name: one is enough to know whether any file but one's own calls it
    users = names.groupBy("name").agg(F.min("user").alias("lo"), F.max("user").alias("hi"))
    return exported.join(users, "name", "left").filter("lo IS NULL OR (lo = file AND hi = file)").select("file", "name")


def fn_info(functions: DataFrame, file: str) -> DataFrame:
    return functions.filter(F.col("file") == file).select("name", "start_line", "end_line", "is_exported", "n_params")


def diff_functions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, name, status): functions added, removed or kept."""
    both = old.select("file", "name", F.lit(1).alias("o")).distinct().join(new.select("file", "name", F.lit(1).alias("n")).distinct(), ["file", "name"], "full")
    return both.select("file", "name", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("kept").alias("status"))


BRANCHES, LOGIC, TERNARY = r"\b(if|for|while|do|switch|case|catch)\b", r"(\?\?|&&|\|\|)", r"\?[^?.]"


def complexity(bodies: DataFrame) -> DataFrame:
    """(id, complexity, depth) of texts (id, text): branches, and the deepest nesting of braces."""
    text = F.coalesce("text", F.lit(""))
    braces = F.split(F.regexp_replace(text, r"[^{}]", ""), "")
    depth = F.aggregate(
        braces,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda acc, c: F.struct(
            (acc["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("now"),
            F.greatest(acc["most"], acc["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("most"),
        ),
    )
    count = lambda p: F.regexp_count(text, F.lit(p))
    return bodies.select("id", (1 + count(BRANCHES) + count(LOGIC) + count(TERNARY)).cast("long").alias("complexity"), depth["most"].cast("long").alias("depth"))


def import_cost(g: Graph, name: str) -> DataFrame:
    """One row (files, lines): what importing a node pulls in."""
    far = loops.bfs(g.edges, g.nodes.filter(F.col("id") == name)).filter("depth > 0")
    return g.nodes.join(far, "id", "left_semi").agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


def churn(commits: DataFrame, degree: DataFrame, k: int = 30) -> DataFrame:
    """(file, changes, coupling, risk): changes times (1 + coupling); ``degree`` has (file, coupling)."""
    n = commits.groupBy("file").agg(F.countDistinct("commit").alias("changes"))
    out = n.join(degree, "file", "left").fillna(0, ["coupling"])
    return out.withColumn("risk", F.col("changes") * (1 + F.col("coupling"))).orderBy(F.col("risk").desc(), "file").limit(k)


def api_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, status): exported names added or removed."""
    added = new.select("name").distinct().join(old.select("name").distinct(), "name", "left_anti").withColumn("status", F.lit("added"))
    return added.union(old.select("name").distinct().join(new.select("name").distinct(), "name", "left_anti").withColumn("status", F.lit("removed")))


def clones(functions: DataFrame, calls: DataFrame, least_lines: int = 3) -> DataFrame:
    """(n_lines, n_calls, n_params, is_exported, n): shapes that two functions or more share."""
    n_calls = calls.groupBy("file", "name").agg(F.count("*").alias("n_calls"))
    shaped = functions.withColumn("n_lines", (F.col("end_line") - F.col("start_line") + 1).cast("long")).filter(F.col("n_lines") >= least_lines)
    shaped = shaped.join(n_calls, ["file", "name"], "left").fillna(0, ["n_calls"])
    return shaped.groupBy("n_lines", "n_calls", "n_params", "is_exported").agg(F.count("*").alias("n")).filter("n >= 2")


def co_changes(commits: DataFrame, least: int = 2, most: int = 30) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, co) of files in one commit of ``least`` to ``most`` files, and (file, n)."""
    # the size by a window: a join with the sizes would sort the commits once more in the same task
    basket = commits.select("commit", "file").filter("commit IS NOT NULL").distinct().withColumn("n", F.count("*").over(Window.partitionBy("commit")))
    basket = basket.filter(F.col("n").between(least, most)).drop("n")
    pairs = basket.toDF("commit", "a").join(basket.toDF("commit", "b"), "commit").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("co")), basket.groupBy("file").agg(F.count("*").alias("n"))


def git_coupling(commits: DataFrame, edges: DataFrame | None = None, k: int = 25) -> DataFrame:
    """(a, b, co, strength, hidden): files that change together; hidden where no import links them."""
    pairs, n = co_changes(commits)
    out = pairs.filter("co >= 2").join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    out = out.select("a", "b", "co", F.round(F.col("co") / F.least("na", "nb"), 6).alias("strength"))
    if edges is not None:
        linked = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("linked", F.lit(True))
        out = out.join(linked, ["a", "b"], "left").select("a", "b", "co", "strength", F.col("linked").isNull().alias("hidden"))
    return out.orderBy(F.col("strength").desc(), "a", "b").limit(k)


def edge_churn(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, commits): how many commits touched both ends of each import.

    The pairs of files within a commit are counted and met with the edges afterwards, as
    a file's edges times its commits can be far more.
    """
    c = commits.select("commit", "file").distinct()
    both = c.toDF("commit", "src").join(c.toDF("commit", "dst"), "commit").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return edges.select("src", "dst").distinct().join(both, ["src", "dst"], "left").select("src", "dst", F.coalesce("n", F.lit(0)).alias("commits"))


def group_churn(commits: DataFrame, groups: DataFrame, tasks: int) -> DataFrame:
    """(src, dst, commits) like ``edge_churn`` for the edges from each file (id, k, rank) to those of higher rank in its groups.

    The edges are not shuffled: a file brings what it has in common with others to its
    ``tasks``-th part, and edges are formed there.
    """
    member = _members(groups.select("id", "k", "rank"))
    c = commits.select("commit", "file").distinct().join(member.withColumnRenamed("id", "file"), "file")
    x, y = c.toDF("src", "commit", "k", "ra", "a"), c.toDF("dst", "commit", "k2", "rb", "b")
    # the group as two comparisons: as a key of the join it would shuffle what lies together by commit
    both = x.join(y, "commit").filter("k <= k2 AND k >= k2 AND ra < rb").filter(_once("a", "b", "k"))
    both = both.groupBy("src", "dst").agg(F.count("*").alias("n")).groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("dst", "n"))).alias("met"))
    x, y = member.toDF("src", "k", "ra", "a"), member.toDF("dst", "k", "rb", "b")
    x = x.join(both, "src", "left").repartition(tasks, "src", "k")
    pairs = x.join(F.broadcast(y), "k").filter("ra < rb").filter(_once("a", "b", "k"))
    return pairs.select("src", "dst", F.coalesce(F.try_element_at("met", F.col("dst")), F.lit(0)).alias("commits"))


def lifespan(commits: DataFrame) -> DataFrame:
    """(file, commits, days, age): time between first and last change, and how old the last one is.

    Ages are relative to the newest commit, not to the clock.
    """
    per = commits.groupBy("file").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.countDistinct("commit").alias("commits"))
    now = per.agg(F.max("last").alias("now"))
    old = F.datediff("now", "last")
    age = F.when(old <= 7, "week").when(old <= 30, "month").when(old <= 90, "quarter").when(old <= 365, "year").otherwise("older")
    return per.join(F.broadcast(now)).select("file", "commits", F.datediff("last", "first").cast("long").alias("days"), age.alias("age"))


def risk(g: Graph, changed: DataFrame, complex_share: float = 0.0) -> DataFrame:
    """One row: points for reach, coupling, complexity and number of changed files; a level."""
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    hit = changed.select("id").distinct().join(g.nodes, "id", "left_semi")
    blast = loops.bfs(back, hit).filter("depth > 0").agg(F.count("*").alias("blast"))
    n = g.nodes.agg(F.count("*").alias("n"))
    ends = g.edges.select(F.col("src").alias("id")).union(g.edges.select("dst")).join(hit, "id", "left_semi").agg(F.count("*").alias("ends"))
    files = hit.agg(F.count("*").alias("files"))
    row = blast.join(n).join(ends).join(files)
    points = {
        "blast_points": ladder(F.col("blast") / F.greatest("n", F.lit(1)), [(0.05, 0), (0.15, 5), (0.3, 10), (0.5, 20)], 30),
        "coupling_points": ladder(F.col("ends") / F.greatest("files", F.lit(1)), [(1, 0), (3, 5), (5, 10), (8, 20)], 30),
        "complexity_points": ladder(F.lit(complex_share), [(0.05, 0), (0.15, 5), (0.3, 10)], 20),
        "file_points": ladder(F.col("files"), [(2, 0), (5, 5), (10, 10), (20, 15)], 20),
    }
    out = row.select(*(v.alias(k) for k, v in points.items())).withColumn("score", sum(F.col(k) for k in points))
    s = F.col("score")
    return out.withColumn("level", F.when(s <= 15, "LOW").when(s <= 35, "MEDIUM").when(s <= 60, "HIGH").otherwise("CRITICAL"))


def diff_impact(g: Graph, changed: DataFrame) -> DataFrame:
    """(id, reached): for each changed node, how many nodes reach it."""
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    far = loops.shortest(back, changed.join(g.nodes, "id", "left_semi")).filter("d > 0").groupBy(F.col("s").alias("id")).agg(F.count("*").alias("reached"))
    return changed.join(far, "id", "left").select("id", F.coalesce("reached", F.lit(0)).alias("reached"))


MAIN_NAMES = ("main", "__main__", "cli", "run", "start", "serve")


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line, text): numbered from 1."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "text")).select("path", (F.col("line") + 1).cast("long").alias("line"), "text")


def entry_points(files: DataFrame) -> DataFrame:
    """(path, line, name, kind): main, test and route definitions; a route's decorator is up to three lines above."""
    define = F.regexp_extract("text", r"^\s*(?:async )?(?:def|function|fn|func) ([A-Za-z_][A-Za-z0-9_]*)", 1)
    w = Window.partitionBy("path").orderBy("line")
    route = F.col("text").rlike(r"^\s*@[A-Za-z_.]+\.(route|get|post|put|delete|patch)\(")
    seen = F.greatest(*(F.coalesce(F.lag(route.cast("int"), i).over(w), F.lit(0)) for i in (1, 2, 3)))
    rows = lines_of(files).select("path", "line", define.alias("name"), seen.alias("routed")).filter("name <> ''")
    kind = F.when(F.col("routed") == 1, "route").when(F.col("name").isin(*MAIN_NAMES), "main").when(F.col("name").startswith("test") | F.col("path").rlike(r"(^|/)tests?/"), "test")
    return rows.select("path", "line", "name", kind.alias("kind")).filter("kind IS NOT NULL")


def decorators(files: DataFrame, part: str = "") -> DataFrame:
    """(path, line, decorator, target): a decorator or attribute with the next definition below it."""
    define = F.regexp_extract("text", r"(?:def|class|fn|struct|function) ([A-Za-z_][A-Za-z0-9_]*)", 1)
    mark = F.regexp_extract("text", r"^\s*(@[A-Za-z_][A-Za-z0-9_.]*|#\[[a-z_]+)", 1)
    below = Window.partitionBy("path").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    rows = lines_of(files).select("path", "line", mark.alias("decorator"), F.nullif(define, F.lit("")).alias("define"))
    rows = rows.withColumn("target", F.first("define", ignorenulls=True).over(below))
    return rows.filter((F.col("decorator") != "") & F.col("decorator").contains(part)).select("path", "line", "decorator", "target")


def callers(files: DataFrame, name: str, k: int = 5000) -> DataFrame:
    """(path, line, text): uses of a name, definitions and exports left out."""
    t = F.col("text")
    hit = lines_of(files).filter(t.rlike(rf"\b{name}\b") & ~t.contains("export ") & ~t.contains(f"function {name}"))
    return hit.select("path", "line", F.substring("text", 1, 100).alias("text")).orderBy("path", "line").limit(k)


def rename(files: DataFrame, old: str, new: str) -> DataFrame:
    """(path, line, before, after): lines a word-wise rename would change."""
    rows = lines_of(files).filter(F.col("text").rlike(rf"\b{old}\b"))
    return rows.select("path", "line", F.col("text").alias("before"), F.regexp_replace("text", rf"\b{old}\b", new).alias("after"))
