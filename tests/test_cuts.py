"""Cut nodes and dominators against brute force on random graphs."""

import random

import pytest

from graphloom.graph import Graph
from graphloom.operators import cuts


def parts(near, gone=None):
    left, n = set(range(len(near))) - {gone}, 0
    while left:
        n += 1
        todo = [left.pop()]
        while todo:
            for y in near[todo.pop()]:
                if y in left:
                    left.remove(y)
                    todo.append(y)
    return n


def reached(out, entry, gone=None):
    seen, todo = {entry}, [entry]
    while todo:
        for y in out[todo.pop()]:
            if y not in seen and y != gone:
                seen.add(y)
                todo.append(y)
    return seen


def drawn(seed, n, m, both):
    rng = random.Random(seed)
    out = [set() for _ in range(n)]
    for _ in range(m):
        x, y = rng.randrange(n), rng.randrange(n)
        if x != y:
            out[x].add(y)
            if both:
                out[y].add(x)
    return [sorted(o) for o in out]


@pytest.mark.parametrize("seed", range(40))
def test_cut_nodes(seed):
    near = drawn(seed, 12, 8 + seed % 14, True)
    want = {x for x in range(12) if near[x] and parts(near, x) > parts(near)}
    assert cuts.cut_nodes(near) == want


@pytest.mark.parametrize("seed", range(40))
def test_immediate_dominators(seed):
    out = drawn(seed, 11, 10 + seed % 20, False)
    live = reached(out, 0)
    doms = {x: {v for v in live if v in (0, x) or x not in reached(out, 0, v)} for x in live}
    want = [-1] * 11
    for x in live:
        want[x] = max(doms[x] - {x}, key=lambda v: len(doms[v]), default=0)
    assert cuts.immediate_dominators(out, 0) == want


def test_leaves_and_cycles_together(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("f", "g"), ("x", "y")]
    nodes = sorted({i for e in edges for i in e})
    g = Graph(spark.createDataFrame([(i, "source", 1) for i in nodes], "id string, kind string, lines long"), spark.createDataFrame(edges, "src string, dst string"))
    assert {r.id for r in cuts.articulation_points(g).collect()} == {"c", "d", "f"}
    tree = {r.id: r.idom for r in cuts.dominator_tree(g, "a").collect()}
    assert tree == {"b": "a", "c": "b", "d": "c", "e": "d", "f": "e", "g": "f"}
