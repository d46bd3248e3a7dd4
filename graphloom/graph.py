"""Typed property graphs as a pair of DataFrames.

Nodes: ``id STRING, kind STRING, lines BIGINT`` and any further columns; ``attrs`` is a
``MAP<STRING, STRING>``. Edges: ``src STRING, dst STRING``, a multiset. The reverse
adjacency is never stored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = (
    "source pe elf macho jclass wasm dll symbol endpoint form table field proto gql oapi docker tf model asm type compiler string overlay "
    "bin_func license cve cert apk permission secret dependency tensor ml_operator section anti_tech crypto cuda_kernel switch_table vtable "
    "com_class com_interface fingerprint yara_rule yara_match packer capa_match decoder"
).split()
ALIASES = {
    "file": "source", "src": "source", "http": "endpoint", "ep": "endpoint", "lib": "dll", "sym": "symbol", "func": "bin_func",
    "function": "bin_func", "dep": "dependency", "lic": "license", "vuln": "cve", "op": "ml_operator", "str": "string", "graphql": "gql",
    "openapi": "oapi", "terraform": "tf", "kernel": "cuda_kernel", "perm": "permission",
}


def parse_kinds(text: str | None, known: set[str] | None = None) -> list[str]:
    """Comma-separated kinds; an exact name wins over an alias, an unknown one is an error."""
    out = []
    for part in filter(None, (p.strip() for p in (text or "").split(","))):
        if part in (known or KINDS):
            out.append(part)
        elif part in ALIASES:
            out.append(ALIASES[part])
        else:
            raise ValueError(f"unknown kind: {part}")
    return out


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def induced(self, kinds: list[str]) -> Graph:
        """The subgraph of some kinds; both ends of an edge must be in it."""
        nodes = self.nodes.filter(F.col("kind").isin(kinds)) if kinds else self.nodes
        return Graph(nodes, local_edges(nodes, self.edges))

    def upsert(self, new: DataFrame) -> Graph:
        """Add nodes (id, kind, attrs). An existing node keeps its kind and columns; new attrs win key by key."""
        old = self.nodes if "attrs" in self.nodes.columns else self.nodes.withColumn("attrs", F.create_map().cast("map<string,string>"))
        merged = new.groupBy("id").agg(F.min("kind").alias("new_kind"), _merge_maps("attrs").alias("new_attrs"))
        out = old.join(merged, "id", "full")
        attrs = F.map_concat(F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(_none_map("new_attrs"), k)), _none_map("new_attrs"))
        rest = [c for c in old.columns if c not in ("id", "kind", "attrs")]
        return replace(self, nodes=out.select("id", F.coalesce("kind", "new_kind").alias("kind"), *rest, attrs.alias("attrs")))

    def connect(self, pairs: DataFrame) -> Graph:
        """Add edges (src, dst): no self loops, no dangling ends, none twice."""
        good = local_edges(self.nodes, pairs.select("src", "dst").filter("src <> dst")).distinct()
        fresh = good.join(self.edges, ["src", "dst"], "left_anti")
        return replace(self, edges=self.edges.select("src", "dst").unionByName(fresh))

    def find(self, name: str) -> DataFrame:
        """The node with this id, else the smallest id that ends with it."""
        hit = self.nodes.filter((F.col("id") == name) | F.col("id").endswith(name))
        return hit.orderBy(F.col("id") != name, "id").limit(1)


def _none_map(name: str):
    return F.coalesce(F.col(name), F.create_map().cast("map<string,string>"))


def _merge_maps(name: str):
    """Maps of a group merged into one; for equal keys the largest value stays."""
    pairs = F.array_sort(F.flatten(F.collect_list(F.map_entries(name))))
    last = F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q["key"] == p["key"]) & (q["value"] > p["value"])))
    return F.map_from_entries(F.array_distinct(last))


def local_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct pairs (x, y) in both directions, without self loops."""
    return edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).union(edges.select("dst", "src")).filter("x <> y").distinct()
