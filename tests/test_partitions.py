"""Flows, cliques and partitions against brute force on random graphs."""

import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from graphloom.graph import Graph
from graphloom.operators import flows, partitions


def drawn(seed, n, share):
    rng = random.Random(seed)
    near = {f"v{i:02}": set() for i in range(n)}
    for x, y in combinations(sorted(near), 2):
        if rng.random() < share:
            near[x].add(y)
            near[y].add(x)
    return near


def quality(near, label):
    m2 = sum(len(n) for n in near.values())
    inside = sum(label[x] == label[y] for x, n in near.items() for y in n)
    totals = {}
    for x, n in near.items():
        totals[label[x]] = totals.get(label[x], 0) + len(n)
    return inside / m2 - sum(t * t for t in totals.values()) / m2**2


def graph(spark, edges, alone=()):
    nodes = sorted({i for e in edges for i in e} | set(alone))
    return Graph(spark.createDataFrame([(i, "source", 1) for i in nodes], "id string, kind string, lines long"), spark.createDataFrame(edges, "src string, dst string"))


@pytest.mark.parametrize("seed", range(20))
def test_cliques_grow_once(seed):
    near = drawn(seed, 10, 0.5)
    got = [frozenset(c) for c in flows.grow_cliques(near, set(), set(near), set())]
    full = lambda c: all(y in near[x] for x, y in combinations(c, 2))
    all_ = [frozenset(c) for k in range(1, 11) for c in combinations(near, k) if full(c)]
    want = {c for c in all_ if not any(c < d for d in all_)}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("seed", range(20))
def test_no_cycle_without_back_edges(seed):
    rng = random.Random(seed)
    out = {f"v{i}": sorted({f"v{rng.randrange(9)}" for _ in range(3)} - {f"v{i}"}) for i in range(9)}
    gone = set(flows.back_edges(out))
    left = {x: {y for y in ys if (x, y) not in gone} for x, ys in out.items()}
    while left:
        free = [x for x, ys in left.items() if not ys & set(left)]
        assert free
        for x in free:
            del left[x]


@pytest.mark.parametrize("seed", range(20))
def test_settled_communities(seed):
    near = drawn(seed, 14, 0.25)
    if not any(near.values()):
        return
    label = partitions.settle({x: dict.fromkeys(n, 1.0) for x, n in near.items()}, dict.fromkeys(near, 0.0))
    assert set(label) == set(near) and all(label[c] == c for c in label.values())
    for c in set(label.values()):  # connected
        part = {x for x in near if label[x] == c}
        assert len(partitions.parts_of({x: near[x] & part for x in part})) == 1
    q = quality(near, label)
    assert q >= quality(near, {x: x for x in near})
    for a, b in combinations(sorted(set(label.values())), 2):  # no two of them are better together
        assert quality(near, {x: a if c == b else c for x, c in label.items()}) <= q + 1e-9


@pytest.mark.parametrize("seed", range(10))
def test_greedy_merges_take_the_best(seed):
    near = drawn(seed, 9, 0.3)
    rows = [(x, y) for x, n in near.items() for y in n]
    if not rows:
        return
    label = {x: x for x in near}
    for gain, kept, gone in partitions.greedy_merges(rows, float(len(rows))):
        before = quality(near, label)
        tries = [quality(near, {x: a if c == b else c for x, c in label.items()}) - before for a, b in combinations(sorted(set(label.values())), 2)]
        label = {x: kept if c == gone else c for x, c in label.items()}
        assert gain == pytest.approx(max(tries)) and quality(near, label) - before == pytest.approx(gain)
    q = quality(near, label)
    assert all(quality(near, {x: a if c == b else c for x, c in label.items()}) <= q + 1e-9 for a, b in combinations(sorted(set(label.values())), 2))


def test_edge_betweenness_of_a_path_and_a_square():
    path = {"a": {"b"}, "b": {"a", "c"}, "c": {"b"}}
    assert partitions.edge_betweenness(path) == {("a", "b"): 4.0, ("b", "c"): 4.0}
    square = {"a": {"b", "d"}, "b": {"a", "c"}, "c": {"b", "d"}, "d": {"a", "c"}}
    assert set(partitions.edge_betweenness(square).values()) == {4.0}


def test_busiest_edge_splits_first():
    near = {x: set() for x in "abcdef"}
    for x, y in ["ab", "bc", "ca", "cd", "de", "ef", "fd"]:
        near[x].add(y)
        near[y].add(x)
    assert partitions.divisions(near, 200, 1) == [(1, "c", "d", [["a", "b", "c"], ["d", "e", "f"]])]


def test_laplacian_of_a_path():
    near = {f"v{i}": {f"v{j}" for j in (i - 1, i + 1) if 0 <= j < 6} for i in range(6)}
    want = [2 - 2 * np.cos(np.pi * k / 6) for k in range(6)]
    assert np.allclose(np.linalg.eigvalsh(partitions._laplacian(near, False)), want)
    assert np.linalg.eigvalsh(partitions._laplacian(near, True))[0] == pytest.approx(0)


def test_k_means_separates():
    points = np.array([[0, 0], [0, 0.1], [5, 5], [5, 5.1], [9, 0]])
    label = partitions.k_means(points, 3)
    assert label[0] == label[1] != label[2] == label[3] != label[4] != label[0]


def test_rows_with_and_without_ends():
    rows = pd.DataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("a", None, 0.0), ("b", None, 0.0), ("z", None, 0.0)], columns=["x", "y", "w"])
    assert dict(partitions._settled(rows).itertuples(index=False)) == {"a": "a", "b": "a", "z": "z"}


def test_two_triangles(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d")], alone=["z"])
    want = {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d", "z": "z"}
    assert {r.id: r.community for r in partitions.leiden(g).collect()} == want
    assert {r.id: r.community for r in partitions.greedy_modularity(g).collect()} == want
    assert {r.members for r in flows.maximal_cliques(g).collect()} == {"a,b,c", "d,e,f"}
    assert flows.max_flow(g, "a", "f").first().flow == 1
    assert {tuple(r) for r in flows.steiner(g, ["b", "e"]).collect()} == {("b", "c"), ("c", "d"), ("d", "e")}
    assert len(flows.feedback_arcs(g).collect()) == 2


def test_nodes_moved_all_at_once(spark):
    pairs = [(x, y, 1.0) for a, b in ("ab", "bc", "ca", "cd", "de", "ef", "fd") for x, y in ((a, b), (b, a))]
    degree = {x: float(sum(p[0] == x for p in pairs)) for x in "abcdef"}
    nodes = spark.createDataFrame([(x, k, 0.0) for x, k in degree.items()], "x string, k double, own double")
    state = dict(partitions._move(spark.createDataFrame(pairs, "x string, y string, w double"), nodes, 14.0, 8).collect())
    near = {x: {p[1] for p in pairs if p[0] == x} for x in "abcdef"}
    assert quality(near, state) > quality(near, {x: x for x in near})


def test_sizes_that_are_refused(spark):
    g = graph(spark, [("a", "b")])
    with pytest.raises(ValueError):
        partitions.spectral_cluster(g, 8)
    with pytest.raises(ValueError):
        partitions._whole(g, 1, "it")
