"""Partitions of the undirected graph: modularity, edge removal, spectra, change over time."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom import loops
from graphloom.graph import Graph, local_edges, undirected
from graphloom.operators.community import label_propagation
from graphloom.session import cut

#: Largest graphs that are solved whole, in one task.
SPECTRAL_NODES = 5000
DIVISIVE_NODES = 500
EPS = 1e-9


def _pairs(g: Graph) -> DataFrame:
    return undirected(local_edges(g.nodes, g.edges))


# ---- Leiden


def _quality(pairs: DataFrame, nodes: DataFrame, state: DataFrame, m2: float) -> float:
    """Modularity of a labelling (x, c) of nodes (x, k, own)."""
    a, b = state.toDF("x", "cx"), state.toDF("y", "cy")
    inside = pairs.join(a, "x").join(b, "y").filter("cx = cy").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("i"))
    own = nodes.agg(F.coalesce(F.sum("own"), F.lit(0.0)).alias("o"))
    squares = nodes.join(state, "x").groupBy("c").agg(F.sum("k").alias("t")).agg(F.coalesce(F.sum(F.col("t") * F.col("t")), F.lit(0.0)).alias("s"))
    r = inside.join(own).join(squares).first()
    return (r.i + r.o) / m2 - r.s / (m2 * m2)


def _move(pairs: DataFrame, nodes: DataFrame, m2: float, rounds: int) -> DataFrame:
    """(x, c): nodes moved to the neighbouring community that raises modularity most.

    All nodes choose at once, so only a share of them, drawn by hash, moves in a round; a
    round that lowers modularity is taken back and the share halved.
    """
    state, share = cut(nodes.select("x", F.col("x").alias("c"))), 2
    quality = _quality(pairs, nodes, state, m2)
    for r in range(rounds):
        total = nodes.join(state, "x").groupBy("c").agg(F.sum("k").alias("total"))
        near = pairs.join(state.toDF("y", "c"), "y").select("x", "c", "w").union(state.select("x", "c", F.lit(0.0)))
        near = near.groupBy("x", "c").agg(F.sum("w").alias("w"))
        k, t = F.col("k"), F.col("total")
        rows = near.join(nodes.select("x", "k"), "x").join(state.toDF("x", "old"), "x").join(total, "c")
        gain = F.round(F.col("w") - k * (t - F.when(F.col("c") == F.col("old"), k).otherwise(0.0)) / m2, 9)
        rows = rows.withColumn("gain", gain).groupBy("x", "old").agg(
            F.min(F.struct((-F.col("gain")).alias("loss"), F.col("c").alias("c"))).alias("best"), F.max(F.when(F.col("c") == F.col("old"), F.col("gain"))).alias("stay")
        )
        better = -F.col("best.loss") > F.col("stay") + EPS
        drawn = F.pmod(F.xxhash64("x", F.lit(r)), F.lit(share)) == 0
        new = cut(rows.select("x", F.when(better & drawn, F.col("best.c")).otherwise(F.col("old")).alias("c"), better.alias("better"), (better & drawn).alias("moved")))
        seen = new.agg(F.count_if("better").alias("better"), F.count_if("moved").alias("moved")).first()
        if not seen.better:
            break
        if not seen.moved:
            continue
        reached = _quality(pairs, nodes, new.select("x", "c"), m2)
        if reached > quality + EPS:
            state, quality = new.select("x", "c"), reached
        else:
            share *= 2
    return state


def settle(near: dict[str, dict[str, float]], own: dict[str, float]) -> dict[str, str]:
    """The part of each node after all levels: nodes move in ascending order until none gains, connected parts merge."""
    m2 = sum(own.values()) + sum(w for n in near.values() for w in n.values())
    out = {x: x for x in near}
    while True:
        degree = {x: own[x] + sum(n.values()) for x, n in near.items()}
        state, total, moved = {x: x for x in near}, dict(degree), True
        while moved:
            moved = False
            for x in sorted(near):
                old, links = state[x], {state[x]: 0.0}
                for y, w in near[x].items():
                    links[state[y]] = links.get(state[y], 0.0) + w
                total[old] -= degree[x]
                best = min(links, key=lambda c: (-round(links[c] - degree[x] * total[c] / m2, 9), c != old, c))
                total[best] += degree[x]
                state[x], moved = best, moved or best != old
        parts = parts_of({x: {y for y in n if state[y] == state[x]} for x, n in near.items()})
        if len(parts) == len(near):
            return out
        name = {x: p[0] for p in parts for x in p}
        out = {x: name[c] for x, c in out.items()}
        held: dict[str, float] = dict.fromkeys(name.values(), 0.0)
        merged: dict[str, dict[str, float]] = {c: {} for c in held}
        for x, n in near.items():
            held[name[x]] += own[x]
            for y, w in n.items():
                if name[x] == name[y]:
                    held[name[x]] += w
                else:
                    merged[name[x]][name[y]] = merged[name[x]].get(name[y], 0.0) + w
        near, own = merged, held


def _settled(rows: pd.DataFrame) -> pd.DataFrame:
    near: dict[str, dict[str, float]] = {x: {} for x in sorted(set(rows["x"]))}
    own = dict.fromkeys(near, 0.0)
    for x, y, w in rows[["x", "y", "w"]].itertuples(index=False):
        if isinstance(y, str):
            near[x][y] = w
        else:
            own[x] += w
    return pd.DataFrame(list(settle(near, own).items()), columns=["c", "label"], dtype=object)


def leiden(g: Graph, rounds: int = 20, levels: int = 10, small: int = 1 << 20) -> DataFrame:
    """(id, community): Leiden communities by modularity, named after their smallest node.

    Each level moves nodes, splits communities into their connected parts and merges each
    part into one node of the next level. Nodes without edges stay alone. While the graph
    has more than ``small`` rows (pairs and nodes) its nodes move all at once, over
    DataFrames; from then on one task goes through the levels that are left.
    """
    pairs = cut(_pairs(g).withColumn("w", F.lit(1.0)))
    part = cut(g.nodes.select("id", F.col("id").alias("c")))
    own = part.select(F.col("id").alias("x"), F.lit(0.0).alias("own"))
    m2 = float(pairs.count())
    for _ in range(levels if m2 else 0):
        if pairs.count() + own.count() <= small:
            rows = pairs.select("x", "y", "w").union(own.select("x", F.lit(None).cast("string"), "own"))
            merged = rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(_settled, "c string, label string")
            part = part.join(merged, "c").select("id", F.col("label").alias("c"))
            break
        degree = pairs.groupBy("x").agg(F.sum("w").alias("w"))
        nodes = cut(own.join(degree, "x", "left").select("x", (F.coalesce("w", F.lit(0.0)) + F.col("own")).alias("k"), "own"))
        state = _move(pairs, nodes, m2, rounds)
        a, b = state.toDF("x", "cx"), state.toDF("y", "cy")
        inner = pairs.join(a, "x").join(b, "y").filter("cx = cy").select(F.col("x").alias("src"), F.col("y").alias("dst"))
        merged = cut(loops.components(inner, state.select(F.col("x").alias("id"))))
        if merged.filter("id <> label").isEmpty():
            break
        part = cut(part.join(merged.toDF("c", "label"), "c").select("id", F.col("label").alias("c")))
        ends = pairs.join(merged.toDF("x", "lx"), "x").join(merged.toDF("y", "ly"), "y").groupBy("lx", "ly").agg(F.sum("w").alias("w")).toDF("x", "y", "w")
        ends = cut(ends)
        held = own.join(merged.toDF("x", "label"), "x").select(F.col("label").alias("x"), "own").union(ends.filter("x = y").select("x", "w"))
        own = cut(held.groupBy("x").agg(F.sum("own").alias("own")))
        pairs = ends.filter("x <> y")
    return part.select("id", F.min("id").over(Window.partitionBy("c")).alias("community"))


# ---- greedy merging


def greedy_merges(rows: list[tuple[str, str]], m2: float) -> list[tuple[float, str, str]]:
    """Merges (gain, kept, gone) that raise modularity most, the smallest pair of several; rows go both ways."""
    near: dict[str, dict[str, float]] = {}
    for x, y in rows:
        near.setdefault(x, {})[y] = 1.0
    degree = {x: float(len(n)) for x, n in near.items()}
    out = []
    while True:
        gains = [(round(2 * (w / m2 - degree[x] * degree[y] / (m2 * m2)), 12), x, y) for x, n in near.items() for y, w in n.items() if x < y]
        best = min(gains, key=lambda t: (-t[0], t[1], t[2]), default=None)
        if best is None or best[0] <= 0:
            return out
        _, kept, gone = best
        out.append(best)
        for z, w in near.pop(gone).items():
            del near[z][gone]
            if z != kept:
                near[kept][z] = near[z][kept] = near[kept].get(z, 0.0) + w
        degree[kept] += degree.pop(gone)


def greedy_modularity(g: Graph, merges: int = 100) -> DataFrame:
    """(id, community): single nodes merged pair by pair while modularity rises, at most ``merges`` times.

    Merges of different components do not touch, so each component finds its own in a task,
    which it must fit. Taking always the best one left is then an order by the least gain
    up to each merge, and the first of these are kept.
    """
    pairs = cut(_pairs(g))
    m2 = float(pairs.count())
    label = loops.components(pairs.toDF("src", "dst"), g.nodes)

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        found = greedy_merges(list(part[["x", "y"]].itertuples(index=False)), m2)
        least = np.minimum.accumulate([f[0] for f in found]) if found else []
        return pd.DataFrame({"label": part["label"].iloc[0], "step": range(len(found)), "least": least, "src": [f[1] for f in found], "dst": [f[2] for f in found]}, columns=["label", "step", "least", "src", "dst"], dtype=object)

    steps = pairs.join(label.toDF("x", "label"), "x").groupBy("label").applyInPandas(merge, "label string, step long, least double, src string, dst string")
    kept = cut(steps.orderBy(F.col("least").desc(), "label", "step").limit(merges))
    return loops.components(kept.select("src", "dst"), g.nodes).withColumnRenamed("label", "community")


# ---- removal of edges


def edge_betweenness(near: dict[str, set[str]]) -> dict[tuple[str, str], float]:
    """Number of shortest paths over each edge (x < y), shared among equal ones; each pair of ends counts twice."""
    out = {(x, y): 0.0 for x, n in near.items() for y in n if x < y}
    for s in near:
        depth, count, order, todo = {s: 0}, {s: 1.0}, [], deque([s])
        while todo:
            x = todo.popleft()
            order.append(x)
            for y in near[x]:
                if y not in depth:
                    depth[y], count[y] = depth[x] + 1, 0.0
                    todo.append(y)
                if depth[y] == depth[x] + 1:
                    count[y] += count[x]
        passed = dict.fromkeys(order, 1.0)
        for y in reversed(order):
            for x in near[y]:
                if depth[x] == depth[y] - 1:
                    flow = passed[y] * count[x] / count[y]
                    out[min(x, y), max(x, y)] += flow
                    passed[x] += flow
    return out


def parts_of(near: dict[str, set[str]]) -> list[list[str]]:
    """Connected components, each ascending, the largest first."""
    left, out = set(near), []
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            part.add(x)
            more = near[x] & left
            left -= more
            todo += more
        out.append(sorted(part))
    return sorted(out, key=lambda p: (-len(p), p))


def divisions(near: dict[str, set[str]], removals: int, first: int) -> list[tuple[int, str, str, list[list[str]]]]:
    """(edges removed, last edge, parts) whenever taking out the busiest edge splits the graph further."""
    out, n = [], len(parts_of(near))
    for k in range(1, removals + 1):
        busy = edge_betweenness(near)
        if not busy or len(out) == first:
            break
        x, y = min(busy, key=lambda e: (-round(busy[e], 9), e))
        near[x].discard(y)
        near[y].discard(x)
        parts = parts_of(near)
        if len(parts) > n:
            n = len(parts)
            out.append((k, x, y, parts))
    return out


def _whole(g: Graph, limit: int, what: str) -> DataFrame:
    """Rows (x, y) of the whole graph for one task, nodes without edges as (x, null)."""
    n = g.nodes.count()
    if n > limit:
        raise ValueError(f"{what} takes {limit} nodes at most, not {n}")
    pairs = _pairs(g)
    return pairs.union(g.nodes.select("id", F.lit(None).cast("string"))).withColumn("all", F.lit(1))


def _near(part: pd.DataFrame) -> dict[str, set[str]]:
    near: dict[str, set[str]] = {x: set() for x in sorted(set(part["x"]))}
    for x, y in part.dropna()[["x", "y"]].itertuples(index=False):
        near[x].add(y)
    return near


def divisive(g: Graph, removals: int = 200, first: int = 5) -> DataFrame:
    """(split, removed, x, y, part, id): the first fragmentations when the busiest edge goes, again and again.

    ``part`` numbers the parts of a split by size. Graphs over 500 nodes are refused: every
    removal needs all shortest paths anew.
    """

    def divide(rows: pd.DataFrame) -> pd.DataFrame:
        found = divisions(_near(rows), removals, first)
        out = [(s, k, x, y, p, v) for s, (k, x, y, parts) in enumerate(found, 1) for p, part in enumerate(parts, 1) for v in part]
        return pd.DataFrame(out, columns=["split", "removed", "x", "y", "part", "id"], dtype=object)

    return _whole(g, DIVISIVE_NODES, "divisive").groupBy("all").applyInPandas(divide, "split long, removed long, x string, y string, part long, id string")


# ---- spectra


def _laplacian(near: dict[str, set[str]], normed: bool) -> np.ndarray:
    place = {x: i for i, x in enumerate(near)}
    a = np.zeros((len(near), len(near)))
    for x, n in near.items():
        a[place[x], [place[y] for y in n]] = 1.0
    d = a.sum(axis=1)
    if not normed:
        return np.diag(d) - a
    s = np.divide(1.0, np.sqrt(d), out=np.zeros_like(d), where=d > 0)
    return np.diag((d > 0).astype(float)) - s[:, None] * a * s[None, :]


def fiedler(g: Graph) -> DataFrame:
    """(id, value, side, connectivity): entries of the second eigenvector of D - A, their sign, and its eigenvalue.

    The first entry that is not zero is positive. A connectivity of 0 means several components.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        near = _near(rows)
        if len(near) < 2:
            return pd.DataFrame(columns=["id", "value", "side", "connectivity"], dtype=object)
        values, vectors = np.linalg.eigh(_laplacian(near, False))
        v = vectors[:, 1]
        lead = next((x for x in v if abs(x) > 1e-9), 1.0)
        v = np.round(v * np.sign(lead), 6) + 0.0
        return pd.DataFrame({"id": list(near), "value": v, "side": (v >= 0).astype(int), "connectivity": round(max(values[1], 0.0), 6) + 0.0}).astype({"id": object})

    return _whole(g, SPECTRAL_NODES, "fiedler").groupBy("all").applyInPandas(solve, "id string, value double, side int, connectivity double")


def spectral_gap(g: Graph, k: int = 25) -> DataFrame:
    """(place, eigenvalue, gap, suggested): the k smallest eigenvalues of D - A and the step to the next one.

    ``suggested`` marks the place after which the largest step comes, those of the
    components' zeros left out: the number of communities that the spectrum suggests.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.round(np.clip(np.linalg.eigvalsh(_laplacian(_near(rows), False))[:k], 0.0, None), 6) + 0.0
        gaps = np.append(np.round(np.diff(values), 6), np.nan)
        open_ = [i for i in range(len(values) - 1) if values[i] >= 1e-6 and gaps[i] > 0]
        best = max(open_, key=lambda i: (gaps[i], -i), default=-1)
        steps = [None if np.isnan(x) else float(x) for x in gaps]
        return pd.DataFrame({"place": range(1, len(values) + 1), "eigenvalue": values, "gap": pd.Series(steps, dtype=object), "suggested": [i == best for i in range(len(values))]})

    return _whole(g, SPECTRAL_NODES, "spectral_gap").groupBy("all").applyInPandas(solve, "place long, eigenvalue double, gap double, suggested boolean")


def k_means(points: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Labels of Lloyd's rounds from centres that lie farthest from those before, the first point first."""
    centres = [points[0]]
    while len(centres) < k:
        d = np.min([((points - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(points[int(np.argmax(np.round(d, 9)))])
    label = np.full(len(points), -1)
    for _ in range(rounds):
        d = np.array([((points - c) ** 2).sum(axis=1) for c in centres])
        new = np.argmin(np.round(d, 9), axis=0)
        if (new == label).all():
            break
        label = new
        centres = [points[label == i].mean(axis=0) if (label == i).any() else centres[i] for i in range(k)]
    return label


def spectral_cluster(g: Graph, k: int = 8) -> DataFrame:
    """(id, cluster): k-means over the normed rows of the k lowest eigenvectors of the normalised Laplacian.

    ``cluster`` is the smallest id in it. Fewer nodes than k, or k outside 2 to 30, is an error.
    """
    if not 2 <= k <= 30 or g.nodes.count() < k:
        raise ValueError(f"spectral_cluster needs 2 to 30 clusters and as many nodes, not {k}")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        near = _near(rows)
        _, vectors = np.linalg.eigh(_laplacian(near, True))
        v = vectors[:, :k]
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        label = k_means(np.divide(v, norm, out=np.zeros_like(v), where=norm > 1e-12), k)
        names = list(near)
        first = {c: min(n for n, d in zip(names, label, strict=True) if d == c) for c in set(label)}
        return pd.DataFrame({"id": names, "cluster": [first[c] for c in label]}, dtype=object)

    return _whole(g, SPECTRAL_NODES, "spectral_cluster").groupBy("all").applyInPandas(solve, "id string, cluster string")


# ---- change over time


def community_evolution(g: Graph, seen: DataFrame, snapshots: int = 4, now: int | None = None) -> DataFrame:
    """(snapshot, event, community, size, peers): births, deaths, splits and merges between snapshots.

    ``seen`` (id, first_seen) dates the nodes; snapshot i holds those seen in the first i
    of equal spans up to ``now`` (the last date if left out). Communities of three or more
    nodes are compared; those of five or more give events: without a peer of Jaccard 0.1
    or more a birth or death, with two or more peers over 0.2 a merge or split.
    """
    if not 2 <= snapshots <= 8:
        raise ValueError(f"2 to 8 snapshots, not {snapshots}")
    ends = seen.agg(F.min("first_seen").alias("a"), F.max("first_seen").alias("b")).first()
    if ends.a is None:
        return g.nodes.sparkSession.createDataFrame([], "snapshot int, event string, community string, size long, peers long")
    step = max((ends.b if now is None else now) - ends.a, 1) / snapshots
    found = []
    for i in range(1, snapshots + 1):
        nodes = g.nodes.join(seen.filter(F.col("first_seen") <= ends.a + step * i), "id", "left_semi")
        labels = label_propagation(Graph(nodes, local_edges(nodes, g.edges)))
        found.append(labels.select(F.lit(i).alias("i"), "id", "label", F.count("*").over(Window.partitionBy("label")).alias("size")).filter("size >= 3"))
    all_ = found[0]
    for f in found[1:]:
        all_ = all_.union(f)
    all_ = cut(all_)
    a = all_.select("i", "id", F.col("label").alias("la"), F.col("size").alias("na"))
    b = all_.select((F.col("i") - 1).alias("i"), "id", F.col("label").alias("lb"), F.col("size").alias("nb"))
    shared = a.join(b, ["i", "id"]).groupBy("i", "la", "na", "lb", "nb").agg(F.count("*").alias("n"))
    shared = cut(shared.withColumn("j", F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))))
    out = None
    for ends_, side, size, alone, many in ((a.filter(F.col("i") < snapshots), "la", "na", "DEATH", "SPLIT"), (b.filter("i > 0"), "lb", "nb", "BIRTH", "MERGE")):
        near = shared.groupBy("i", side).agg(F.max("j").alias("best"), F.count_if(F.col("j") > 0.2).alias("peers"))
        row = ends_.select("i", side, size).distinct().filter(F.col(size) >= 5).join(near, ["i", side], "left").fillna(0.0, ["best"]).fillna(0, ["peers"])
        event = F.when(F.col("best") < 0.1, alone).when(F.col("peers") >= 2, many)
        row = row.select(F.col("i").alias("snapshot"), event.alias("event"), F.col(side).alias("community"), F.col(size).alias("size"), "peers").filter("event IS NOT NULL")
        out = row if out is None else out.union(row)
    return out
