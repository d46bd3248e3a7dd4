"""Queries over cut nodes, dominators, exports, bridges between languages, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import analysis, composite, cuts, dataflow, security
from graphloom.plans.catalog import SQL, query
from graphloom.plans.tables import FILES, FK, FUNCTIONS, TRADE, calls, files, fk_graph, functions, read, trade_graph
from graphloom.session import cut

BRIDGE_KINDS = ("pybind11", "torch_library", "triton_kernel", "cuda_kernel", "monkey_patch", "yaml_dispatch", "native_call")


@query(f"""WITH {FK}, p AS (SELECT DISTINCT x, y FROM (SELECT src AS x, dst AS y FROM e UNION ALL SELECT dst, src FROM e) WHERE x <> y),
g AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id)
SELECT g.id, degree FROM g JOIN (SELECT x FROM p GROUP BY x HAVING count(*) > 1) q ON q.x = g.id ORDER BY degree DESC, g.id LIMIT 30""")
def bridges(spark: SparkSession, d: str) -> DataFrame:
    """The foreign keys are a forest, where every inner node is a cut node."""
    return cuts.articulation_points(fk_graph(spark, d))


@query(f"""WITH RECURSIVE {TRADE}, h AS (SELECT src, dst FROM e WHERE src NOT IN ('n01', 'n02') AND dst NOT IN ('n01', 'n02') AND (src < 'n12') = (dst < 'n12')
UNION SELECT 'n11', 'n12'), v AS (SELECT DISTINCT x, y FROM (SELECT src AS x, dst AS y FROM h UNION ALL SELECT dst, src FROM h)),
r AS (SELECT x AS cut, min(y) AS id FROM v GROUP BY x UNION SELECT r.cut, v.y FROM r JOIN v ON v.x = r.id WHERE v.y <> r.cut)
SELECT g.id, g.degree FROM (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM h UNION ALL SELECT dst FROM h) GROUP BY id) g
WHERE EXISTS (SELECT 1 FROM v WHERE v.x = g.id AND v.y NOT IN (SELECT r.id FROM r WHERE r.cut = g.id)) ORDER BY g.degree DESC, g.id LIMIT 30""")
def bridges_of_cyclic(spark: SparkSession, d: str) -> DataFrame:
    """Two halves of the nations that one edge joins: cut nodes of a graph with cycles."""
    g = trade_graph(spark, d)
    low = lambda c: F.col(c) < "n12"
    kept = g.edges.filter(~F.col("src").isin("n01", "n02") & ~F.col("dst").isin("n01", "n02") & (low("src") == low("dst")))
    return cuts.articulation_points(Graph(g.nodes, kept.union(spark.sql("SELECT 'n11', 'n12'")).distinct()))


@query(f"""WITH RECURSIVE {TRADE}, v AS (SELECT id AS cut FROM n WHERE id <> 'n00'),
r AS (SELECT cut, 'n00' AS id FROM v UNION SELECT r.cut, e.dst FROM r JOIN e ON e.src = r.id WHERE e.dst <> r.cut),
a AS (SELECT 'n00' AS id UNION SELECT e.dst FROM a JOIN e ON e.src = a.id),
dom AS (SELECT v.cut AS d, a.id FROM v JOIN a ON a.id <> v.cut AND NOT EXISTS (SELECT 1 FROM r WHERE r.cut = v.cut AND r.id = a.id) WHERE v.cut IN (SELECT id FROM a)
UNION ALL SELECT 'n00', id FROM a WHERE id <> 'n00'),
k AS (SELECT id, count(*) AS k FROM dom GROUP BY id)
SELECT dom.id, max_by(dom.d, coalesce(k.k, 0)) AS idom FROM dom LEFT JOIN k ON k.id = dom.d GROUP BY dom.id""")
def dominator_tree(spark: SparkSession, d: str) -> DataFrame:
    return cuts.dominator_tree(trade_graph(spark, d), "n00")


@query(f"WITH {FUNCTIONS} SELECT file AS id, count(DISTINCT name) AS n FROM fn WHERE is_exported GROUP BY file ORDER BY n DESC, id LIMIT 30")
def exports(spark: SparkSession, d: str) -> DataFrame:
    nodes = functions(spark, d).filter("is_exported").groupBy(F.col("file").alias("id")).agg(F.collect_set("name").alias("exports"))
    return analysis.exports(nodes)


def bridge_table(spark: SparkSession, d: str) -> DataFrame:
    """Parts as bridges between languages: the kind goes by their number."""
    kind = F.element_at(F.array(*map(F.lit, BRIDGE_KINDS)), (F.pmod("p_partkey", F.lit(len(BRIDGE_KINDS))) + 1).cast("int"))
    name, target = F.concat(F.lit("op"), F.pmod("p_partkey", F.lit(50)).cast("string")), F.concat(F.lit("t"), F.pmod("p_partkey", F.lit(11)).cast("string"))
    return read(spark, d, "part").select(
        F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("file"), kind.alias("kind"), name.alias("name"), target.alias("target"), F.col("p_partkey").cast("long").alias("line"), F.lit("aten").alias("namespace")
    )


_BRIDGES = f"""b AS (SELECT 'part:' || p_partkey AS file, [{", ".join(f"'{k}'" for k in BRIDGE_KINDS)}][CAST(p_partkey % {len(BRIDGE_KINDS)} + 1 AS INT)] AS kind,
  'op' || (p_partkey % 50) AS name, 't' || (p_partkey % 11) AS target, CAST(p_partkey AS BIGINT) AS line, 'aten' AS namespace FROM part)"""


@query(f"WITH {_BRIDGES} SELECT * FROM b")
def lang_bridges(spark: SparkSession, d: str) -> DataFrame:
    return dataflow.bridges(bridge_table(spark, d))


@query(f"WITH {_BRIDGES} SELECT * FROM b WHERE kind IN ('triton_kernel', 'cuda_kernel')")
def gpu_functions(spark: SparkSession, d: str) -> DataFrame:
    return dataflow.bridges(bridge_table(spark, d), dataflow.GPU_KINDS)


@query(f"WITH {_BRIDGES} SELECT * FROM b WHERE kind = 'monkey_patch'")
def monkey_patches(spark: SparkSession, d: str) -> DataFrame:
    return dataflow.bridges(bridge_table(spark, d), ("monkey_patch",))


@query(f"WITH {_BRIDGES} SELECT name, namespace, target, line FROM b WHERE kind IN ('torch_library', 'yaml_dispatch')")
def dispatch_map(spark: SparkSession, d: str) -> DataFrame:
    return dataflow.dispatch_map(bridge_table(spark, d))


def _health(g: Graph, circular: DataFrame | None = None) -> DataFrame:
    cycles = (analysis.circular(g) if circular is None else circular).agg(F.count("*").alias("n"))
    return analysis.health(g, cycles, g.nodes.sparkSession.sql("SELECT 0.15D AS share"))


@query(f"""WITH {FK}, {FUNCTIONS}, hs AS ({SQL["hotspots"].replace(f"WITH {FK}, g AS", "WITH g AS").replace("LIMIT 30", "LIMIT 5")}), he AS ({SQL["health"].replace(f"WITH {FK}, deg", "WITH deg")})
SELECT 'total' AS section, 'files' AS name, count(*) AS n FROM n UNION ALL SELECT 'total', 'lines', CAST(sum(lines) AS BIGINT) FROM n UNION ALL SELECT 'total', 'edges', count(*) FROM e
UNION ALL SELECT 'coupled', id, total FROM hs
UNION ALL SELECT 'called', callee, c FROM (SELECT callee, count(*) AS c FROM ca GROUP BY callee ORDER BY c DESC, callee LIMIT 5)
UNION ALL SELECT 'health', grade, score FROM he""")
def summary(spark: SparkSession, d: str) -> DataFrame:
    g = fk_graph(spark, d)
    return composite.summary(g, calls(spark, d), _health(g))


@query(f"""WITH {FK}, he AS ({SQL["health"].replace(f"WITH {FK}, deg", "WITH deg")}), {FILES}, sc AS ({SQL["secret_scan"].replace(f"WITH {FILES}, ", "WITH ").replace(f"WITH {FILES}", "WITH fl0 AS (SELECT 1)")}),
k AS (SELECT 'health' AS "check", score::DOUBLE AS value, score >= 60 AS passed FROM he UNION ALL SELECT 'cycles', 0, true
UNION ALL SELECT 'dead_files', (SELECT count(*) FROM n WHERE id NOT IN (SELECT dst FROM e))::DOUBLE / (SELECT count(*) FROM n), (SELECT count(*) FROM n WHERE id NOT IN (SELECT dst FROM e))::DOUBLE / (SELECT count(*) FROM n) < 0.1
UNION ALL SELECT 'secrets', (SELECT count(*) FROM sc WHERE severity = 'critical'), (SELECT count(*) FROM sc WHERE severity = 'critical') = 0)
SELECT * FROM k UNION ALL SELECT 'all', sum(passed::INT)::DOUBLE, bool_and(passed) FROM k""")
def validate(spark: SparkSession, d: str) -> DataFrame:
    g = fk_graph(spark, d)
    circular = cut(analysis.circular(g))
    # the report counts critical secrets, so the rules for others are not tried
    critical = [rule for rule in security.SECRET_RULES if rule[1] == "critical"]
    return composite.validate(g, circular, _health(g, circular), security.secret_scan(files(spark, d), critical))
