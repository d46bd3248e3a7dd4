"""Graph texts, as one document and as written lines, and paths between two nodes."""

import json
import xml.dom.minidom

import pytest

from graphloom.graph import Graph
from graphloom.operators import analysis, export, navigation, security


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame([('a"<&>', "source", 1), ("b", "dll", 1), ("c", "dll", 1)], "id string, kind string, lines long")
    return Graph(nodes, spark.createDataFrame([('a"<&>', "b"), ("b", "c"), ("b", "c")], "src string, dst string"))


@pytest.mark.parametrize("form", sorted(export.FORMATS))
def test_written_lines_are_the_document(g, form, tmp_path):
    document = getattr(export, f"to_{form}")(g).first().document
    export.write(g, form, str(tmp_path / form))
    parts = sorted((tmp_path / form).glob("part-*"))
    assert "".join(p.read_text() for p in parts).split("\n") == document.rstrip("\n").split("\n") + [""]
    if form in ("graphml", "gexf"):
        found = xml.dom.minidom.parseString(document)
        assert {n.getAttribute("id") for n in found.getElementsByTagName("node")} == {'a"<&>', "b", "c"}
        assert len(found.getElementsByTagName("edge")) == 2


def test_json(g):
    found = json.loads(export.to_json(g).first().document)
    assert len(found["nodes"]) == 3 and found["edges"] == [{"src": 'a"<&>', "dst": "b"}, {"src": "b", "dst": "c"}]


def test_why_turns_round(g):
    rows = lambda a, b, limit=None: [r.id for r in navigation.why(g.edges, a, b, limit).orderBy("step").collect()]
    assert rows('a"<&>', "c") == rows("c", 'a"<&>') == ['a"<&>', "b", "c"]
    assert rows('a"<&>', "c", 1) == rows("b", "z") == [] and rows("b", "b") == ["b"]


def test_context_fits_its_budget(spark):
    files = spark.createDataFrame([(f"f{i}", 10 - i, 0) for i in range(9)] + [("big", 100, 2)], "id string, rank int, chars long")
    assert [r.id for r in analysis.context(files, 1).orderBy("used").collect()] == ["big", "f0"]
    assert analysis.context(files, 0).count() == 0


def test_cve_match_both_ways(spark):
    dlls = spark.createDataFrame([("libopenssl-1.1.dll",), ("zlib1.dll",), ("ab.dll",), (None,)], "id string")
    cves = spark.createDataFrame([("C1", "HIGH", ["openssl", "ssl"]), ("C2", "LOW", ["super_zlib_tool", "ab"]), ("C3", None, ["curl"]), ("C4", "LOW", None)], "id string, severity string, products array<string>")
    assert {tuple(r) for r in security.cve_match(dlls, cves).collect()} == {("libopenssl-1.1.dll", "C1", "HIGH"), ("zlib1.dll", "C2", "LOW")}
