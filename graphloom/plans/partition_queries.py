"""Queries over flows, cliques, partitions, schema texts and composed reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import analysis, centrality, composite, export, flows, partitions
from graphloom.plans.catalog import SQL, query
from graphloom.plans.more_queries import _health
from graphloom.plans.tables import TRADE, calls, commits, fk_graph, functions, read, trade_graph
from graphloom.sources import schemas

_CLIQUES = f"""{TRADE}, nb AS (SELECT x, list_sort(list(y)) AS ys FROM u GROUP BY x),
cl AS (SELECT [x] AS m, ys AS cand FROM nb UNION ALL SELECT list_append(cl.m, nb.x), list_intersect(cl.cand, nb.ys) FROM cl JOIN nb ON list_contains(cl.cand, nb.x) AND nb.x > cl.m[-1]),
mc AS (SELECT m FROM cl WHERE len(cand) = 0 AND len(m) >= 3)"""


@query()
def clusters(spark: SparkSession, d: str) -> DataFrame:
    return partitions.leiden(trade_graph(spark, d))


@query(f"WITH RECURSIVE {_CLIQUES} SELECT array_to_string(m, ',') AS members, CAST(len(m) AS BIGINT) AS size FROM mc")
def cliques(spark: SparkSession, d: str) -> DataFrame:
    return flows.maximal_cliques(trade_graph(spark, d))


@query(f"""WITH RECURSIVE {_CLIQUES}, k AS (SELECT array_to_string(m, ',') AS id, m FROM mc WHERE len(m) >= 4),
r AS (SELECT id, id AS other, m FROM k UNION SELECT r.id, k.id, k.m FROM r JOIN k ON len(list_intersect(r.m, k.m)) >= 3),
l AS (SELECT id, min(other) AS community FROM r GROUP BY id) SELECT DISTINCT unnest(k.m) AS id, community FROM l JOIN k USING (id)""")
def k_clique_4(spark: SparkSession, d: str) -> DataFrame:
    return flows.clique_communities(trade_graph(spark, d), 4)


@query()
def max_flow(spark: SparkSession, d: str) -> DataFrame:
    return flows.max_flow(trade_graph(spark, d), "n00", "n11")


@query()
def steiner(spark: SparkSession, d: str) -> DataFrame:
    return flows.steiner(trade_graph(spark, d), ["n00", "n05", "n11", "n17", "n23"])


@query()
def feedback_arc(spark: SparkSession, d: str) -> DataFrame:
    return flows.feedback_arcs(trade_graph(spark, d))


@query()
def modularity_max(spark: SparkSession, d: str) -> DataFrame:
    return partitions.greedy_modularity(trade_graph(spark, d))


@query()
def divisive(spark: SparkSession, d: str) -> DataFrame:
    return partitions.divisive(trade_graph(spark, d))


@query()
def fiedler(spark: SparkSession, d: str) -> DataFrame:
    return partitions.fiedler(trade_graph(spark, d))


@query()
def spectral_cluster(spark: SparkSession, d: str) -> DataFrame:
    return partitions.spectral_cluster(trade_graph(spark, d), 5)


@query()
def spectral_gap(spark: SparkSession, d: str) -> DataFrame:
    return partitions.spectral_gap(trade_graph(spark, d))


@query()
def community_evolution(spark: SparkSession, d: str) -> DataFrame:
    """Nations are seen from the day that their number gives."""
    g = trade_graph(spark, d)
    seen = read(spark, d, "nation").select(F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("id"), (F.col("n_nationkey") * 86400).cast("long").alias("first_seen"))
    return partitions.community_evolution(g, seen)


@query()
def audit(spark: SparkSession, d: str) -> DataFrame:
    g = trade_graph(spark, d)
    return composite.audit(g, centrality.betweenness(g), centrality.structural_holes(g), partitions.leiden(g))


@query(f"""SELECT 'risk' AS section, level AS name, score AS n FROM ({SQL["risk"]})
UNION ALL SELECT 'files', 'changed', count(*) FROM nation WHERE n_nationkey < 3
UNION ALL SELECT 'files', 'reached', (SELECT count(*) FROM customer WHERE c_nationkey < 3) + (SELECT count(*) FROM supplier WHERE s_nationkey < 3)
  + (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 3)
UNION ALL SELECT 'functions', status, count(*) FROM ({SQL["diff_functions"]}) GROUP BY status
UNION ALL SELECT 'churn', file, risk FROM (SELECT * FROM ({SQL["churn"]}) ORDER BY risk DESC, file LIMIT 10)""")
def changeset(spark: SparkSession, d: str) -> DataFrame:
    g, f = fk_graph(spark, d), functions(spark, d)
    return composite.changeset(g, g.nodes.filter("kind = 'nation' AND lines < 3").select("id"), f.filter("n_params <> 0"), f.filter("n_params <> 2"), commits(spark, d))


@query(f"""SELECT 'stats ' || section AS section, name, n FROM ({SQL["stats"]}) UNION ALL SELECT 'health', grade, score FROM ({SQL["health"]})
UNION ALL SELECT 'layer', CAST(depth AS VARCHAR), count(*) FROM ({SQL["layers"]}) GROUP BY depth
UNION ALL SELECT 'key file', id, total FROM (SELECT * FROM ({SQL["hotspots"]}) ORDER BY total DESC, id LIMIT 10)
UNION ALL SELECT 'summary ' || section, name, n FROM ({SQL["summary"]}) UNION ALL SELECT 'map', id, chars FROM ({SQL["context"]})""")
def handoff(spark: SparkSession, d: str) -> DataFrame:
    g = fk_graph(spark, d)
    files = g.nodes.filter("kind = 'customer'").select("id", F.col("lines").alias("rank"), F.length("id").cast("long").alias("chars"))
    return composite.handoff(g, calls(spark, d), _health(g), files, 1000)


@query(SQL["hotspots"])
def action_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The last result of three actions in a row."""
    g = fk_graph(spark, d)
    actions = {"stats": lambda _: analysis.stats(g), "trace": lambda target: analysis.trace(g, target), "hotspots": lambda _: analysis.hotspots(g)}
    return composite.run_steps(actions, composite.parse_steps("stats, trace:nation:3, hotspots"))[-1][1]


def _quoted(words: list[str]) -> str:
    return " OR ".join("contains(lower(goal), '" + w.replace("'", "''") + "')" for w in words)


_CASES = " ".join(f"WHEN {_quoted(words)}{' OR goal ILIKE ' + chr(39) + '%.so' + chr(39) if intent == 'reverse_elf' else ''} THEN '{intent}'" for intent, words in composite.INTENTS)
_STEPS = " ".join(f"WHEN '{intent}' THEN '{' '.join(steps)}'" for intent, steps in composite.INTENT_STEPS.items())


@query(f"""WITH q AS (SELECT coalesce(text, '') AS goal FROM conversations), i AS (SELECT CASE WHEN trim(goal, ' ') = '' OR regexp_matches(goal, '(^|\\s)https?://') THEN 'rejected' {_CASES} ELSE 'fallback' END AS intent FROM q)
SELECT intent, CASE intent {_STEPS} ELSE '' END AS steps, count(*) AS n FROM i GROUP BY ALL""")
def think(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of the conversations as a goal: how often each intent is meant, and what it runs."""
    goals = read(spark, d, "conversations").select(F.col("text").alias("goal"), F.array().cast("array<string>").alias("paths"))
    return composite.think(goals).groupBy("intent", F.concat_ws(" ", "steps").alias("steps")).agg(F.count("*").alias("n"))


def _texts(spark: SparkSession, d: str, head: str, line: str, suffix: str) -> DataFrame:
    """One text a region: a head, then a block for each of its nations in ascending order."""
    fill = lambda text: F.replace(F.replace(F.lit(text), F.lit("$n"), F.col("n_nationkey").cast("string")), F.lit("$r"), F.col("n_regionkey").cast("string"))
    rows = read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", fill(line).alias("t")))).alias("l"), F.max(fill(head)).alias("h"))
    body: Column = F.array_join(F.transform("l", lambda x: x["t"]), "\n")
    return rows.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(suffix)).alias("path"), F.concat_ws("\n", "h", body).alias("content"))


@query("""SELECT 'r' || r_regionkey || '.proto' AS path, 'message' AS kind, 'Region' || r_regionkey AS owner, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS refers, CAST(NULL AS VARCHAR) AS type FROM region
UNION ALL SELECT 'r' || r_regionkey || '.proto', 'field', 'Region' || r_regionkey, 'key', NULL, 'int32' FROM region
UNION ALL SELECT 'r' || n_regionkey || '.proto', 'message', 'N' || n_nationkey, NULL, NULL, NULL FROM nation
UNION ALL SELECT 'r' || n_regionkey || '.proto', 'field', 'N' || n_nationkey, 'home', 'Region' || n_regionkey, 'Region' || n_regionkey FROM nation
UNION ALL SELECT 'r' || n_regionkey || '.proto', 'enum', 'N' || n_nationkey || '.Kind', NULL, NULL, NULL FROM nation
UNION ALL SELECT 'r' || n_regionkey || '.proto', 'value', 'N' || n_nationkey || '.Kind', 'A', NULL, '0' FROM nation""")
def proto_schema(spark: SparkSession, d: str) -> DataFrame:
    line = "message N$n { // a nation {\n  repeated Region$r home = 1;\n  enum Kind { A = 0; }\n}"
    return schemas.proto_schema(_texts(spark, d, 'syntax = "proto3";\nmessage Region$r { int32 key = 1; }', line, ".proto"))


@query("""SELECT 'r' || n_regionkey || '.graphql' AS path, 'N' || n_nationkey AS src, 'Region' || n_regionkey AS dst FROM nation
UNION ALL SELECT 'r' || n_regionkey || '.graphql', 'N' || n_nationkey, 'Filter' FROM nation""")
def graphql_schema(spark: SparkSession, d: str) -> DataFrame:
    text = _texts(spark, d, "# all\ntype Region$r { key: ID! }", 'type N$n @key(fields: "id") { "its region" home(by: Filter, top: Int = 3): [Region$r!]! name: String }', ".graphql")
    return schemas.schema_edges(schemas.graphql_schema(text))


@query("""SELECT 'r' || n_regionkey || '.yml' AS path, 'n' || n_nationkey AS service, CAST(1 AS BIGINT) AS level FROM nation
UNION ALL SELECT 'r' || r_regionkey || '.yml', 'db', 0 FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)""")
def docker_map(spark: SparkSession, d: str) -> DataFrame:
    """Start order of a base service and those that need it, first to start with level 0."""
    text = _texts(spark, d, "services:\n  db:\n    image: base:$r\n", "  n$n:\n    image: n\n    ports: ['80:80']\n    depends_on: [db]\n", ".yml")
    return schemas.start_order(schemas.docker_map(text))


@query("""SELECT 'data_net.r' || n_regionkey AS src, 'var.zone' || n_regionkey AS dst FROM nation UNION SELECT 'app_node.n' || n_nationkey, 'data_net.r' || n_regionkey FROM nation""")
def terraform_map(spark: SparkSession, d: str) -> DataFrame:
    head = 'variable "zone$r" {}\nresource "data_net" "r$r" {\n  zone = var.zone$r # not var.other\n}'
    return schemas.terraform_edges(schemas.terraform_map(_texts(spark, d, head, 'resource "app_node" "n$n" {\n  net = "${data_net.r$r.id}"\n}', ".tf")))


@query(f"""WITH {TRADE} SELECT 'digraph g {{' AS line UNION ALL SELECT '  "' || id || '" [label="' || id || '", class="' || kind || '"];' FROM n
UNION ALL SELECT '  "' || src || '" -> "' || dst || '";' FROM e UNION ALL SELECT '}}'""")
def dot(spark: SparkSession, d: str) -> DataFrame:
    return export.lines(trade_graph(spark, d), "dot")


@query(f"""WITH {TRADE} SELECT '<?xml version="1.0" encoding="UTF-8"?>' AS line UNION ALL SELECT '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'
UNION ALL SELECT '  <key id="kind" for="node" attr.name="kind" attr.type="string"/>' UNION ALL SELECT '  <graph edgedefault="directed">'
UNION ALL SELECT '    <node id="' || id || '"><data key="kind">' || kind || '</data></node>' FROM n
UNION ALL SELECT '    <edge source="' || src || '" target="' || dst || '"/>' FROM e UNION ALL SELECT '  </graph>' UNION ALL SELECT '</graphml>'""")
def graphml(spark: SparkSession, d: str) -> DataFrame:
    return export.lines(trade_graph(spark, d), "graphml")
