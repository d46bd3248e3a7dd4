"""Graphs as text: one row (document) for a view of a graph, or sorted lines written over all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _joined(df: DataFrame, text: Column) -> DataFrame:
    """All lines of a small graph in order. Text formats are one document, so this is for views of a graph."""
    return df.select(text.alias("t")).agg(F.array_join(F.array_sort(F.collect_list("t")), "\n").alias("t"))


def _document(g: Graph, head: str, node: Column, edge: Column, middle: str, tail: str) -> DataFrame:
    n = _joined(g.nodes, node).withColumnRenamed("t", "n")
    e = _joined(g.edges.distinct(), edge).withColumnRenamed("t", "e")
    return n.join(e).select(F.concat(F.lit(head), "n", F.lit(middle), "e", F.lit(tail)).alias("document"))


def _sorted(g: Graph, head: str, node: Column, edge: Column, middle: str, tail: str) -> DataFrame:
    spark = g.nodes.sparkSession
    fixed = [(place, i, line) for place, text in ((0, head), (2, middle), (4, tail)) for i, line in enumerate(text.strip("\n").split("\n")) if line]
    out = spark.createDataFrame(fixed, "place int, i int, line string")
    out = out.union(g.nodes.select(F.lit(1), F.lit(0), node)).union(g.edges.distinct().select(F.lit(3), F.lit(0), edge))
    return out.orderBy("place", "i", "line").select("line")


def to_json(g: Graph) -> DataFrame:
    n = g.nodes.agg(F.array_sort(F.collect_list(F.struct("id", "kind"))).alias("nodes"))
    e = g.edges.distinct().agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("edges"))
    return n.join(e).select(F.to_json(F.struct("nodes", "edges")).alias("document"))


def _dot() -> tuple[str, Column, Column, str, str]:
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    node = F.concat(F.lit("  "), q(F.col("id")), F.lit(" [label="), q(F.col("id")), F.lit(", class="), q(F.col("kind")), F.lit("];"))
    return "digraph g {\n", node, F.concat(F.lit("  "), q(F.col("src")), F.lit(" -> "), q(F.col("dst")), F.lit(";")), "\n", "\n}\n"


def _mermaid() -> tuple[str, Column, Column, str, str]:
    name = lambda c: F.concat(F.lit("x"), F.substring(F.sha2(c, 256), 1, 12))
    node = F.concat(F.lit("  "), name(F.col("id")), F.lit('["'), F.replace(F.col("id"), F.lit('"'), F.lit("'")), F.lit('"]'))
    return "flowchart LR\n", node, F.concat(F.lit("  "), name(F.col("src")), F.lit(" --> "), name(F.col("dst"))), "\n", "\n"


def _graphml() -> tuple[str, Column, Column, str, str]:
    node = F.concat(F.lit('    <node id="'), _xml(F.col("id")), F.lit('"><data key="kind">'), _xml(F.col("kind")), F.lit("</data></node>"))
    edge = F.concat(F.lit('    <edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('"/>'))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n  <key id="kind" for="node" attr.name="kind" attr.type="string"/>\n  <graph edgedefault="directed">\n'
    return head, node, edge, "\n", "\n  </graph>\n</graphml>\n"


def _gexf() -> tuple[str, Column, Column, str, str]:
    node = F.concat(F.lit('      <node id="'), _xml(F.col("id")), F.lit('" label="'), _xml(F.col("kind")), F.lit('"/>'))
    edge = F.concat(F.lit('      <edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('"/>'))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3">\n  <graph defaultedgetype="directed">\n    <nodes>\n'
    return head, node, edge, "\n    </nodes>\n    <edges>\n", "\n    </edges>\n  </graph>\n</gexf>\n"


FORMATS = {"dot": _dot, "mermaid": _mermaid, "graphml": _graphml, "gexf": _gexf}


def to_dot(g: Graph) -> DataFrame:
    return _document(g, *_dot())


def to_mermaid(g: Graph) -> DataFrame:
    return _document(g, *_mermaid())


def to_graphml(g: Graph) -> DataFrame:
    return _document(g, *_graphml())


def to_gexf(g: Graph) -> DataFrame:
    return _document(g, *_gexf())


def lines(g: Graph, form: str) -> DataFrame:
    """(line): the document of a format line by line, nodes and edges in order of their text."""
    return _sorted(g, *FORMATS[form]())


def write(g: Graph, form: str, path: str) -> None:
    """Write the lines of a graph of any size as text files, which make the document in the order of their names."""
    lines(g, form).write.mode("errorifexists").text(path)
