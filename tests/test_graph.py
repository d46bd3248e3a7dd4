"""The graph model and loops on small graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from graphloom import loops
from graphloom.graph import Graph, parse_kinds
from graphloom.operators import community, links, paths

NODES = [("file:src1.py", "source"), ("file:src2.py", "source"), ("ep:GET:users", "endpoint"), ("ep:POST:orders", "endpoint"), ("table:users", "table"), ("table:orders", "table")]
EDGES = [
    ("file:src1.py", "ep:GET:users"), ("file:src1.py", "ep:POST:orders"), ("file:src2.py", "ep:GET:users"),
    ("ep:GET:users", "table:users"), ("ep:POST:orders", "table:orders"), ("table:orders", "table:users"),
]


@pytest.fixture(scope="module")
def typed(spark):
    return Graph(spark.createDataFrame(NODES, "id string, kind string"), spark.createDataFrame(EDGES, "src string, dst string"))


def test_meta_paths(typed):
    assert links.meta_path(typed, ["source", "endpoint", "table"]).count() == 3
    assert links.meta_path(typed, ["source", "endpoint"]).count() == 3
    assert links.meta_path(typed, ["endpoint", "table"]).count() == 2


def test_upsert_keeps_the_kind_and_connect_adds_once(spark, typed):
    new = spark.createDataFrame([("file:src1.py", "pe", {"a": "1"}), ("dll:x", "dll", {"b": "2"})], "id string, kind string, attrs map<string,string>")
    g = typed.upsert(new).upsert(new)
    got = {r["id"]: (r["kind"], r["attrs"]) for r in g.nodes.collect()}
    assert len(got) == 7 and got["file:src1.py"] == ("source", {"a": "1"}) and got["dll:x"] == ("dll", {"b": "2"})
    pairs = spark.createDataFrame([("file:src1.py", "dll:x"), ("file:src1.py", "dll:x"), ("dll:x", "dll:x"), ("dll:x", "none"), EDGES[0]], "src string, dst string")
    assert g.connect(pairs).connect(pairs).edges.count() == len(EDGES) + 1


def test_kinds():
    assert parse_kinds("file, endpoint") == ["source", "endpoint"]
    assert parse_kinds("fingerprint") == ["fingerprint"]
    with pytest.raises(ValueError):
        parse_kinds("nothing")


def test_loops(spark, typed):
    reached = {r["id"]: r["depth"] for r in loops.bfs(typed.edges, typed.nodes.filter("id = 'file:src1.py'")).collect()}
    assert reached == {"file:src1.py": 0, "ep:GET:users": 1, "ep:POST:orders": 1, "table:users": 2, "table:orders": 2}
    lone = Graph(typed.nodes.union(spark.createDataFrame([("x", "source")], typed.nodes.schema)), typed.edges)
    assert sorted(r["n"] for r in community.islands(lone).select("n").collect()) == [1, 6]
    assert paths.scc(typed).groupBy("component").count().filter(F.col("count") > 1).count() == 0
