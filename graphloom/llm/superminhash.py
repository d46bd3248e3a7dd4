"""Near-duplicate groups by SuperMinHash signatures.

1. Each text's set of distinct word shingles gives a SuperMinHash signature: every
   element walks the slots in the order of its own random permutation and offers the
   slot reached at step j a value in [j, j + 1); the slot keeps the smallest. Steps are
   done for all elements of a batch at once and end for a document as soon as no slot
   can improve, which for long documents is after the first one or two.
2. Texts with equal sets are one node from here on. Bands of a signature are hashed to
   keys; nodes that share a key are candidates.
   Shingles that no other candidate has bound what a node can share; nodes whose bound
   stays under the threshold leave the buckets, so loose copies of one text, which share
   buckets with all others but are linked with none, cost nothing further.
3. Candidates are verified on whole sets. Every node is first tried against the hub that
   it shares most keys with (a bucket's hub is the node with the smallest share of
   shingles of its own); what is linked is one component already.
4. Buckets that still hold several components are settled relative to their hub h: a
   member x is its difference D(x) = x xor h, and the difference of two members is
   D(x) xor D(y), so two short arrays decide a pair. Buckets up to a fixed amount of work
   settled by an inverted index of the differences in one task, which returns a spanning
   set of links and no pairs. Larger ones are narrowed first: if both members are linked
   with h nothing is left to prove, else the threshold asks for a least overlap of D(x)
   and D(y), so the two share one of the first elements of D in an order that puts
   elements of many members last (prefix filter); each of these elements is a bucket of
   the next level, a part of its parent without the hub. What is too large then as well
   (copies that share most of their edits) is dealt into pairs of blocks.
5. Components come from label propagation with pointer jumping over written tables.

A pair at the threshold shares no band with probability (1 - s^rows)^bands: 6e-11 at
0.85 and 5e-8 at 0.8 for 32 bands of 4 rows; candidates beyond that are complete.

Edge cases: null, empty or blank texts have an empty set, are linked with nothing and
are their own component; fewer words than a shingle count as one shingle; repeated rows
share a node; a null doc_id takes part in links but is never a component's id unless no
other row is there (then the component's id is null and its rows are kept); an empty
table gives an empty result; extra columns are ignored, or carried by :func:`first_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import tokens
from graphloom.llm import words as W
from graphloom.llm.store import discard, materialize

BANDS, ROWS = 32, 4
#: Members times elements of their differences that one task settles at most; larger units are split.
WORK = 1 << 29
_ONE = np.uint64(1)
_STEP = np.uint64(0xD1B54A32D192ED03)


def signatures(hashes: np.ndarray, doc: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """SuperMinHash of the elements of each document: (n_docs, slots), infinite where empty."""
    sig = np.full((n_docs, slots), np.inf)
    flat = sig.reshape(-1)
    perm = None
    for j in range(slots):
        if j:
            # a document is finished once its largest slot value is below what step j can offer
            live = sig.max(axis=1) > j
            keep = live[doc]
            hashes, doc = hashes[keep], doc[keep]
            if not len(doc):
                break
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.uint8), (len(doc), 1))
                rows, k = np.arange(len(doc)), at[keep]
                perm[rows, k] = 0
                perm[rows, 0] = k
            elif not keep.all():
                perm = perm[keep]
        salt = np.uint64(((2 * j + 1) * int(_STEP)) % (1 << 64))
        draw = W.mix(hashes + salt)
        value = j + (draw >> np.uint64(11)).astype(np.float64) / (1 << 53)
        k = (j + W.mix(hashes + salt + _STEP) % np.uint64(slots - j)).astype(np.int64)
        if j == 0:
            at = k
        else:
            rows = np.arange(len(doc))
            at = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
            perm[rows, j] = at
        np.minimum.at(flat, doc * slots + at, value)
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _STEP, bits.shape[:2]).copy()
    for r in range(rows):
        key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, r])
    return key.view(np.int64)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lowered)."""
    words = W.split(texts, lower=True)
    tokens_ = words.token_hashes()
    grams = W.ngrams(tokens_, size)
    out = []
    for a, b in zip(words.offsets.tolist(), words.offsets[1:].tolist(), strict=False):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(W.ngrams(tokens_[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _node(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def signed(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Rows (doc_id, text_key, n_shingles, node, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "n_shingles", "node", "keys"]
        for b in tokens.pieces(batches, most=2 << 20):
            sets = shingle_sets(b.column("text"), size)
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            keys: list = [None] * len(sets)
            if len(full):
                doc = np.repeat(np.arange(len(full)), n[full])
                found = band_keys(signatures(np.concatenate([sets[i] for i in full]), doc, len(full), bands * rows), bands, rows)
                for i, k in zip(full.tolist(), found.tolist(), strict=True):
                    keys[i] = k
            cols = [b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array([_node(s) for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names)

    rows_ = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows_.mapInArrow(run, "doc_id long, text_key long, n_shingles long, node binary, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Whole sets of the wanted nodes (node, id, text_key): their texts are fetched by doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.pieces(batches, most=2 << 20):
            sets = shingle_sets(b.column("text"), size)
            cols = [pa.array([_node(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["node", "set"])

    rows = docs.select(_id("doc_id").alias("id"), F.xxhash64("text").alias("text_key"), "text")
    found = rows.join(wanted, ["id", "text_key"], "left_semi").select("text")
    return found.mapInArrow(run, "node binary, set array<long>").dropDuplicates(["node"])


def _id(name: str):
    return F.coalesce(name, F.lit(-(1 << 63)))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (a, b, common, united) of the pairs' whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).cast("long").alias("both"))
        .select("a", "b", "common", (F.col("both") - F.col("common")).alias("united"))
    )


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) for the nodes of ``edges`` (a, b): the smallest node of each component.

    Each round takes the least label among neighbours and then that label's own label;
    the state is a written table, and a count of changes is all that reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").filter("node <> other").distinct()
    both = materialize(both, "edges")
    state = materialize(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(state.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("m"))
        met = state.join(near, "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        jump = state.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = met.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old")
        new = materialize(new, "labels")
        changed = new.filter("label <> old").limit(1).count()
        discard(state)
        state = new.select("node", "label")
        if not changed:
            discard(both)
            return state


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after linking pairs (a, b): components of the graph of labels."""
    name = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
    met = links.join(name("a"), "a").join(name("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).filter("a <> b").distinct()
    merged = components(met).select(F.col("node").alias("label"), F.col("label").alias("new"))
    return materialize(labels.join(merged, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "nodes")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _profiles(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (node, size, own): how many shingles a node has, and how many of them no other candidate has.

    A link needs ``percent`` of the shingles shared, so nodes with fewer that others have are left out.
    """
    named = sets.select("node", F.xxhash64("node").alias("nid"), F.size("set").cast("long").alias("size"), "set")
    alone = named.select("nid", F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("nid").alias("nid"))
    own = alone.filter("n = 1").groupBy("nid").agg(F.count("*").alias("own"))
    found = named.select("node", "nid", "size").join(own, "nid", "left").select("node", "size", F.coalesce("own", F.lit(0)).cast("long").alias("own"))
    return found.filter(f"100 * (size - own) >= {percent} * size")


def _possible(members: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Rows (node, key, alone) of the members that may have a link in their bucket.

    A node of ``size`` shingles, ``own`` of them its own, shares size - own with a node of
    m shingles at most, of own + m that they have together at least. m is no less than the
    smallest size in the bucket among those that ``percent`` allows; sizes are classed by
    powers of 100 / percent, so allowed ones are at most a class away.
    """
    step = math.log(100 / percent)
    placed = members.join(profiles, "node").withColumn("class", F.floor(F.log("size") / step).cast("int"))
    least = placed.groupBy("key", "class").agg(F.min("size").alias("least"))
    of_key = least.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("class", "least"))).alias("least"))
    near = F.least(*(F.try_element_at("least", F.col("class") + i) for i in (-1, 0, 1)))
    shared = F.col("size") - F.col("own")
    other = F.greatest(near, F.ceil(F.col("size") * percent / 100), shared)
    kept = placed.join(of_key, "key").filter(100 * shared >= percent * (other + F.col("own")))
    return materialize(kept.select("node", "key", (F.col("own") / F.col("size")).alias("alone")), "members")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (key, node, alone) of the keys that hold nodes with different labels."""
    named = members.join(labels, "node")
    several = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    return members.join(several, "key", "left_semi")


def _with_hub(members: DataFrame) -> DataFrame:
    """Adds ``hub``, the member with the smallest share of shingles of its own, and leaves it out of the rows."""
    hubs = members.groupBy("key").agg(F.min(F.struct("alone", "node")).alias("h")).select("key", F.col("h.node").alias("hub"))
    return members.join(hubs, "key").filter("node <> hub")


def _deltas(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Adds size, hub_size, delta (the shingles that node or hub has alone) and linked to rows (unit, hub, node, alone)."""
    own = sets.select("node", F.col("set").alias("set_a"))
    of_hub = sets.select(F.col("node").alias("hub"), F.col("set").alias("set_h"))
    met = units.join(own, "node").join(of_hub, "hub")
    delta = F.concat(F.array_except("set_a", "set_h"), F.array_except("set_h", "set_a"))
    out = met.select("unit", "hub", "node", "alone", F.size("set_a").cast("long").alias("size"), F.size("set_h").cast("long").alias("hub_size"), delta.alias("delta"))
    return out.withColumn("linked", (100 + percent) * F.size("delta") <= (100 - percent) * (F.col("size") + F.col("hub_size")))


def _unsettled(deltas: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of units that hold several labels, with node_label, hub_label, n (members) and work."""
    names = labels.withColumnRenamed("label", "node_label")
    named = deltas.join(names, "node").join(names.toDF("hub", "hub_label"), "hub")
    several = named.groupBy("unit").agg(
        F.count("*").alias("n"),
        (F.count("*") * F.sum(F.size("delta"))).alias("work"),
        F.min(F.least("node_label", "hub_label")).alias("lo"),
        F.max(F.greatest("node_label", "hub_label")).alias("hi"),
        F.bool_and("linked").alias("all_linked"),
    )
    several = several.filter("lo <> hi AND NOT all_linked AND n > 1").select("unit", "n", "work")
    return named.join(several, "unit")


def _dealt(units: DataFrame, work: int) -> DataFrame:
    """Each unit as pairs of blocks of its rows, every pair a unit of at most about ``work``."""
    blocks = F.ceil(2 * F.sqrt(F.col("work") / work)).cast("int")
    rows = units.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("unit", F.xxhash64("unit", F.least("own", "other"), F.greatest("own", "other"))).drop("blocks", "own", "other")


def _settled(units: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the labels of each unit's nodes as all its pairs would."""

    def settle(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        delta = table.column("delta").combine_chunks()
        size, linked = table.column("size").to_numpy(), table.column("linked").to_numpy()
        d = pc.list_value_length(delta).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.unique(delta.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1]
        ends = np.cumsum(d)
        order = np.argsort(codes, kind="stable")
        holder = np.repeat(np.arange(len(d)), d)[order]  # the members that have each element
        first = np.searchsorted(codes[order], np.arange(codes.max() + 2 if len(codes) else 1))
        name = np.unique(np.array([x.hex() for x in table.column("node_label").to_pylist()]), return_inverse=True)[1]
        out = []
        for x in np.flatnonzero(~linked).tolist():  # two linked ones are in the hub's component
            if (name == name[x]).all():
                continue
            own = codes[ends[x] - d[x] : ends[x]]
            met = holder[W.ranges(first[own], first[own + 1] - first[own])]
            shared = np.bincount(met, minlength=len(d))
            near = (100 + percent) * (d[x] + d - 2 * shared) <= (100 - percent) * (size[x] + size)
            for y in np.flatnonzero(near & (name != name[x])).tolist():
                if name[y] != name[x]:
                    out.append((nodes[x], nodes[y]))
                    name[name == name[y]] = name[x]
        return pa.table([pa.array([r[i] for r in out], pa.binary()) for i in (0, 1)], names=["a", "b"])

    rows = units.select("unit", "node", "node_label", "size", "linked", "delta")
    return rows.groupBy("unit").applyInArrow(settle, "a binary, b binary")


def _narrowed(open_: DataFrame, percent: int) -> DataFrame:
    """Rows (key, node, alone) of the buckets in which each pair that may still be linked meets.

    With d = |D(x)|, sizes s and H of x and hub and c = (100 - percent) / (100 + percent), a
    link asks for 2 |D(x) & D(y)| >= d + |D(y)| - c (s + |y|). An unlinked partner has
    |D(y)| > c (|y| + H), which leaves more than (d + c (H - s)) / 2; a linked partner has
    at least the overlap as |D(y)| and at most s * 100 / percent shingles, which leaves
    d - s (100 - percent) / percent. Pairs of two unlinked nodes and pairs of an unlinked
    with a linked one meet in buckets of different kinds.
    """
    c, g, e = (100 - percent) / (100 + percent), (100 - percent) / percent, 1e-6
    # elements that many members of a unit have: under 8 times a delta's average length, whatever the unit holds
    often = open_.select("unit", "n", F.explode("delta").alias("x")).groupBy("unit", "x").agg(F.count("*").alias("times"), F.any_value("n").alias("n"))
    often = often.filter("times > 1 AND 8 * times > n").groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("x", "times"))).alias("often"))
    d, s, h = F.size("delta"), F.col("size"), F.col("hub_size")
    half = F.greatest(F.lit(1), F.floor((d + c * (h - s)) / 2 - e) + 1)
    far = F.greatest(F.lit(1), F.ceil(d - s * g - e))
    order = "array_sort(transform(delta, x -> struct(coalesce(try_element_at(often, x), 0L) AS times, xxhash64(x) AS mixed, x AS x)))"
    sorted_ = open_.join(often, "unit", "left").withColumn("delta", F.expr(f"transform({order}, s -> s.x)"))
    first = lambda least: F.slice("delta", 1, F.greatest(F.lit(0), d - least + 1).cast("int"))
    kind = lambda name, part: F.struct(F.lit(name).alias("kind"), part.alias("elements"))
    nothing = F.slice("delta", 1, 0)
    kinds = F.array(
        kind("unlinked", F.when(F.col("linked"), nothing).otherwise(first(half))),
        kind("mixed", F.when(F.col("linked"), first(half)).when(d - s * g - e <= h * g, first(far)).otherwise(nothing)),
    )
    by_kind = sorted_.select("unit", "node", "alone", F.explode(kinds).alias("k"))
    out = by_kind.select("unit", "node", "alone", "k.kind", F.explode("k.elements").alias("x"))
    return out.select(F.xxhash64("unit", "x", "kind").alias("key"), "node", "alone")


def node_labels(docs: DataFrame, rows: DataFrame, size: int, percent: int, work: int = WORK) -> DataFrame:
    """Rows (node, label) of the nodes that share a band key with another one."""
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct(_id("doc_id").alias("id"), "text_key")).alias("at"), F.any_value("keys").alias("keys"))
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("key")
    members = materialize(buckets.join(shared, "key", "left_semi"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "at.id", "at.text_key"), "node").select("id", "text_key")
    sets = materialize(_sets(docs, wanted, size), "sets")

    linked = f"100 * common >= {percent} * united"
    members = _possible(members, _profiles(sets, percent), percent)
    # Round 1: the hub of a bucket is the node with the smallest share of shingles of its own; each node tries the hub that it meets most often.
    hubs = members.groupBy("key").agg(F.min(F.struct("alone", "node")).alias("h")).select("key", F.col("h.node").alias("hub"))
    met = members.join(hubs, "key").filter("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("n"))
    best = met.groupBy("node").agg(F.max(F.struct("n", "hub")).alias("m")).select(*_pair("node", "m.hub")).distinct()
    tested = [materialize(_verified(best, sets), "pairs")]
    labels = _relabel(materialize(members.select("node").distinct().select("node", F.col("node").alias("label")), "nodes"), tested[0].filter(linked))

    level = _open(members, labels)
    group = F.xxhash64(F.lit(0), "hub")  # keys with one hub are one unit, so each node tries a hub once
    units = materialize(_with_hub(level).select(group.alias("unit"), "hub", "node", "alone").distinct(), "units")
    for last in (False, True):
        deltas = materialize(_deltas(units, sets, percent), "deltas")
        links = deltas.filter("linked").select(F.col("node").alias("a"), F.col("hub").alias("b"))
        older, labels = labels, _relabel(labels, links)
        unsettled = materialize(_unsettled(deltas, labels), "unsettled")
        small, large = unsettled.filter(f"work <= {work}"), unsettled.filter(f"work > {work}")
        found = materialize(_settled(small.unionByName(_dealt(large, work)) if last else small, percent), "links")
        later, labels = labels, _relabel(labels, found)
        for used in (units, deltas, older, later, found):
            discard(used)
        if last or not large.limit(1).count():
            discard(unsettled)
            break
        narrowed = materialize(_narrowed(large, percent), "narrowed")
        units = materialize(_with_hub(_open(narrowed, labels)).select(F.col("key").alias("unit"), "hub", "node", "alone"), "units")
        discard(narrowed)
        discard(unsettled)
    for used in (sets, members, *tested):
        discard(used)
    return labels


def grouped(docs: DataFrame, size: int = 5, percent: int = 80, work: int = WORK) -> DataFrame:
    """Rows (doc_id, text_key, n_shingles, component_id, first_key): the class of every row.

    ``component_id`` is the smallest doc_id of the class, ``first_key`` the text key of the
    row that stands for it. Links need 100 * common >= percent * united shingles.
    """
    rows = materialize(signed(docs, size), "signed")
    labels = node_labels(docs, rows, size, percent, work)
    per_node = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    named = per_node.join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("class"))
    classes = named.groupBy("class").agg(F.min("first").alias("least"))
    of_node = named.join(classes, "class").select("node", "least")
    full = rows.filter("node IS NOT NULL").join(of_node, "node")
    full = full.select("doc_id", "text_key", "n_shingles", F.col("least.doc_id").alias("component_id"), F.col("least.text_key").alias("first_key"))
    blank = rows.filter("node IS NULL").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.col("text_key").alias("first_key"))
    return full.unionByName(blank)


def digest(docs: DataFrame, size: int = 5, percent: int = 80, work: int = WORK) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    out = grouped(docs, size, percent, work)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def first_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their class, one each; rows without words all stay."""
    chosen = grouped(docs, size, percent).filter("n_shingles > 0 AND doc_id <=> component_id AND text_key = first_key")
    chosen = chosen.select(_id("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_, text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    rows = docs.toDF(*names).withColumn("id", _id(id_)).withColumn("key", F.xxhash64(text))
    worded = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = rows.filter(worded).join(chosen, ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    return kept.unionByName(rows.filter(~worded)).select(*names).toDF(*docs.columns)
