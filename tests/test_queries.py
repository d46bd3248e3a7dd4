"""Registered queries against their SQL at the smallest size."""

import math
import os

import pytest

from graphloom.operators import centrality
from graphloom.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = (
    "stats trace coupling dead_files hotspots size compare context coupling_delta git_coupling edge_churn node_lifespan clones api_diff "
    "dead_functions diff_functions structural_holes dispersion group_centrality common_neighbors jaccard adamic_adar meta_path triangles "
    "subgraph_iso similar secret_scan license_scan complexity callers rename web_endpoints web_dom web_sitemap string_classes transitions "
    "bridges_of_cyclic dominator_tree exports dispatch_map summary validate cliques changeset handoff action_pipeline think proto_schema "
    "graphql_schema terraform_map dot graphml"
).split()


def plain(v):
    if v is None or isinstance(v, (int, bool)):
        return v
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted((tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in order) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str) == want


@pytest.mark.parametrize(("name", "expect"), [("second_order", (50, 50)), ("current_flow_closeness", (30, 50))])
def test_walk_queries_use_as_many_and_as_long_walks_as_the_reference(spark, monkeypatch, name, expect):
    seen = []

    def walks(g, walks, steps, seed):
        seen.append((walks, steps))
        return g.nodes.limit(0).selectExpr("id AS s", "0 AS walk", "id AS x", "1 AS step")

    monkeypatch.setattr(centrality, "_walks", walks)
    catalog.QUERIES[name](spark, SF)
    assert seen == [expect]
