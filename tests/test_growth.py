"""Findings of the third round: right rows where an earlier form failed, and the same rows from the faster forms."""

import math
import random

import pytest
from graphloom import loops
from graphloom.graph import Graph
from graphloom.operators import analysis, composite, functions, links, paths, rank, scans


def graph(spark, edges, more=()):
    ids = sorted({x for e in edges for x in e} | set(more))
    return Graph(spark.createDataFrame([(i, "source", 1) for i in ids], "id string, kind string, lines long"), spark.createDataFrame(edges, "src string, dst string"))


def test_astar_gives_no_path_where_only_the_way_back_exists(spark):
    g = graph(spark, [("b", "m"), ("m", "a"), ("a", "x")])
    assert paths.astar(g, "a", "b").collect() == []
    assert [r["id"] for r in paths.astar(g, "b", "a").orderBy("step").collect()] == ["b", "m", "a"]


CALLS = [("f1", "p", "q"), ("f1", "p", "q"), ("f2", "q", "r"), ("f3", "r", "q"), ("f4", "s", "s"), ("f4", "s", "t")]
FUNCTIONS = [("f1", "q", True), ("f2", "q", True), ("f2", "r", True), ("f2", "r", True), ("f3", "q", True), ("f3", "t", False), ("f4", "s", True), ("f4", "u", True)]
GROUPS = [("f1", 1, 1), ("f2", 1, 2), ("f2", 2, 2), ("f3", 1, 3), ("f3", 2, 3), ("f5", 2, 5)]


def tables(spark):
    return spark.createDataFrame(FUNCTIONS, "file string, name string, is_exported boolean"), spark.createDataFrame(CALLS, "file string, name string, callee string"), spark.createDataFrame(GROUPS, "id string, k int, rank long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_call_graph_of_groups_gives_each_call_of_the_pairs_once(spark):
    f, c, g = tables(spark)
    pairs = [(a, b) for a, x, _ in GROUPS for b, y, _ in GROUPS if x == y and a != b]
    want = rows(functions.call_graph(f, c, spark.createDataFrame(pairs, "src string, dst string")))
    assert rows(functions.call_graph_of_groups(f, c, g)) == want and len(want) == 8


def test_call_graph_meets_calls_within_the_group_only(spark):
    """On 40 groups that export one name, calls times exporters would be 40 times the rows."""
    f = spark.range(400).selectExpr("concat('f', id) AS file", "concat('x', id % 1) AS name", "true AS is_exported")
    c = spark.range(400).selectExpr("concat('f', id) AS file", "'y' AS name", "concat('x', id % 1) AS callee")
    g = spark.range(400).selectExpr("concat('f', id) AS id", "id % 40 AS k")
    df = functions.call_graph_of_groups(f, c, g)
    assert df.count() == 4000
    joins = [line for line in plan(df).splitlines() if "Join Inner" in line and "callee" in line.replace("name#", "callee#")]
    assert joins and all("key" in line for line in joins)


COMMITS = [(1, "f1"), (1, "f2"), (1, "f3"), (2, "f2"), (2, "f3"), (2, "f3"), (3, "f5"), (3, "f2"), (4, "f9")]


def test_group_churn_counts_like_edge_churn(spark):
    commits = spark.createDataFrame(COMMITS, "commit long, file string")
    groups = spark.createDataFrame(GROUPS, "id string, k int, rank long")
    pairs = {(a, b) for a, x, r in GROUPS for b, y, s in GROUPS if x == y and r < s}
    want = rows(functions.edge_churn(commits, spark.createDataFrame(sorted(pairs), "src string, dst string")))
    assert rows(functions.group_churn(commits, groups, 2)) == want
    assert dict(((a, b), n) for a, b, n in want) == {("f1", "f2"): 1, ("f1", "f3"): 1, ("f2", "f3"): 2, ("f2", "f5"): 1, ("f3", "f5"): 0}


def test_edge_churn_does_not_multiply_edges_with_commits(spark):
    """A file with 2,000 edges in 2,000 commits of its own was 4,000,000 rows, which have no use."""
    commits = spark.range(2000).selectExpr("id AS commit", "'hub' AS file")
    edges = spark.range(2000).selectExpr("'hub' AS src", "concat('f', id) AS dst")
    df = functions.edge_churn(commits, edges)
    assert df.agg({"commits": "sum"}).first()[0] == 0 and df.count() == 2000
    joined = [line for line in plan(df).splitlines() if "Join Inner" in line]
    assert joined and all("commit" in line for line in joined)


def test_orphan_exports_and_unused_exports_agree(spark):
    f, c, _ = tables(spark)
    used = c.selectExpr("file", "callee AS name")
    imports = c.selectExpr("file AS src", "callee AS name").join(f.selectExpr("file AS dst", "name"), "name").filter("src <> dst").select("src", "dst").distinct()
    want = [("f2", "r"), ("f4", "s"), ("f4", "u")]
    assert rows(analysis.orphan_exports(f.filter("is_exported"), imports, used)) == want
    assert rows(functions.unused_exports(f.filter("is_exported"), used.withColumnRenamed("file", "user"))) == want


@pytest.mark.parametrize("by", ["common", "jaccard", "adamic_adar"])
@pytest.mark.parametrize("k", [5, 2000])
def test_top_links_are_the_best_of_all_pairs(spark, monkeypatch, by, k):
    """Few edges a block, ties, adjacent pairs, self loops and ends that are no nodes."""
    monkeypatch.setattr(links, "BLOCK_ENTRIES", 40)
    draw = random.Random(5)
    edges = [(f"v{draw.randrange(60)}", f"v{draw.randrange(draw.choice([5, 60]))}") for _ in range(240)]
    g = graph(spark, edges, ["lone"])
    g = Graph(g.nodes, g.edges.union(spark.createDataFrame([("v1", "gone"), ("gone", "v2")], g.edges.schema)))
    got = [tuple(r) for r in links.top_links(g, by, k).collect()]
    assert got == [tuple(r) for r in links.best_links(links.link_scores(g), by, k).collect()] and len(got) >= 5
    assert "Python" not in plan(links.link_scores(g)) and "FlatMapGroupsInArrow" in plan(links.top_links(g, by, k))


def test_entropy_reads_bytes_as_they_are(spark):
    """Hexadecimal texts and a sorted array of them were made of every byte."""
    texts = {1: "aab", 2: "é€", 3: "", 4: None, 5: "".join(map(chr, range(128))) * 3}
    df = scans.entropy(spark.createDataFrame([(k, None if v is None else v.encode()) for k, v in texts.items()], "id long, data binary"))
    want = {k: 0.0 if not v else round(-sum(p * math.log2(p) for p in [v.encode().count(b) / len(v.encode()) for b in set(v.encode())]), 6) for k, v in texts.items()}
    assert {r["id"]: r["entropy"] for r in df.collect()} == want and want[5] == 7.0
    assert {r["id"] for r in df.filter("packed").collect()} == {5}
    assert "regexp_extract_all" not in plan(df)


def forest(draw, n=60):
    """Trees of all shapes, pairs, single nodes and a few cycles."""
    edges = [(f"v{i}", f"v{draw.randrange(i)}") for i in range(1, n) if draw.random() < 0.8]
    edges += [(f"c{i}", f"c{(i + 1) % 7}") for i in range(7)] + [("c3", "v0"), ("p1", "p2"), ("p2", "p1"), ("s", "s"), ("t1", "t0")]
    return [(b, a) if draw.random() < 0.5 else (a, b) for a, b in edges]


def test_stripped_components_are_components(spark):
    """Stars and chains lose all their rows to stripping, so that rounds of labels have less to do."""
    other = {f"v{i}": f"v{(i * 37 + 11) % 60}" for i in range(60)}
    g = graph(spark, [(other.get(a, a), other.get(b, b)) for a, b in forest(random.Random(7))], ["alone"])
    assert rows(loops.stripped_components(g.edges, g.nodes).select("id", "label")) == rows(loops.components(g.edges, g.nodes).select("id", "label"))


def test_circular_looks_for_components_in_what_can_lie_on_a_cycle(spark):
    draw = random.Random(3)
    g = graph(spark, forest(draw) + [(f"w{draw.randrange(12)}", f"w{draw.randrange(12)}") for _ in range(16)] + [("x1", "x2"), ("x2", "x3"), ("x3", "x1")])
    want = rows(paths.scc(g).groupBy("component").count().filter("count > 1"))
    assert rows(analysis.circular(g)) == want and len(want) >= 2
    tree = graph(spark, [(f"o{i}", f"c{i % 9}") for i in range(200)] + [(f"c{i}", f"n{i % 3}") for i in range(9)] + [("n0", "r")])
    assert loops.cyclic_core(tree.edges).count() == 0 and analysis.circular(tree).count() == 0


def test_trophic_levels_are_the_means_of_all_in_neighbours(spark):
    edges = forest(random.Random(11)) + [("v5", "v2"), ("v5", "v2")]
    g = graph(spark, edges, ["alone"])
    g = Graph(g.nodes, g.edges.union(spark.createDataFrame([("gone", "v2"), ("v2", "gone")], g.edges.schema)))
    level = {r["id"]: 1.0 for r in g.nodes.collect()}
    for _ in range(50):
        new = {v: 1 + (sum(level[a] for a, b in edges if b == v) / n if (n := sum(b == v for _, b in edges)) else 0) for v in level}
        change, level = max(abs(new[v] - level[v]) for v in level), new
        if change < 1e-6:
            break
    got = {r["id"]: r["score"] for r in rank.trophic(g).collect()}
    assert got.keys() == level.keys() and all(abs(got[v] - level[v]) < 1e-9 for v in level)


def test_validate_reads_its_parts_once(spark):
    """The row of all checks computed the other four again."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    g = graph(spark, [("a", "b")])
    health = spark.createDataFrame([(70, "C")], "score long, grade string")
    secrets = spark.createDataFrame([("critical",), ("high",)], "severity string").mapInPandas(look, "severity string")
    got = {r["check"]: (r["value"], r["passed"]) for r in composite.validate(g, g.nodes.limit(0), health, secrets).collect()}
    assert got == {"health": (70.0, True), "cycles": (0.0, True), "dead_files": (0.5, False), "secrets": (1.0, False), "all": (2.0, False)}
    assert seen.value == 2
