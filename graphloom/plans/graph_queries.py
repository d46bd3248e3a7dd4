"""Queries over the foreign-key graph, the trade graph and the supply graph."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import loops
from graphloom.graph import Graph
from graphloom.operators import analysis, centrality, community, links, navigation, paths, rank
from graphloom.plans.catalog import query
from graphloom.plans.tables import FK, PATHS, SUPPLY, TRADE, fk_graph, read, supply_graph, trade_graph


@query(f"""WITH {FK} SELECT 'total' AS section, 'files' AS name, count(*) AS n FROM n
UNION ALL SELECT 'total', 'lines', CAST(sum(lines) AS BIGINT) FROM n UNION ALL SELECT 'total', 'edges', count(*) FROM e
UNION ALL SELECT 'kind', kind, count(*) FROM n GROUP BY kind""")
def stats(spark: SparkSession, d: str) -> DataFrame:
    return analysis.stats(fk_graph(spark, d))


@query(f"WITH {FK} SELECT 'imports' AS section, dst AS other FROM e WHERE src = 'nation:3' UNION ALL SELECT 'imported_by', src FROM e WHERE dst = 'nation:3'")
def trace(spark: SparkSession, d: str) -> DataFrame:
    return analysis.trace(fk_graph(spark, d), "nation:3")


@query(f"""WITH RECURSIVE {FK}, r AS (SELECT src AS id, CAST(1 AS BIGINT) AS depth FROM e WHERE dst = 'region:1'
UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.id WHERE r.depth < 9) SELECT id, min(depth) AS depth FROM r GROUP BY id""")
def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    return analysis.blast_radius(fk_graph(spark, d), "region:1")


@query(f"WITH {FK} SELECT src AS id, count(DISTINCT dst) AS n FROM e WHERE contains(dst, 'nation:1') GROUP BY src")
def coupling(spark: SparkSession, d: str) -> DataFrame:
    return analysis.coupling(fk_graph(spark, d), "nation:1")


@query(f"WITH {FK} SELECT id FROM n WHERE id NOT IN (SELECT dst FROM e)")
def dead_files(spark: SparkSession, d: str) -> DataFrame:
    return analysis.dead_files(fk_graph(spark, d))


@query(f"""WITH {FK}, g AS (SELECT id, sum(o) AS n_out, sum(i) AS n_in FROM (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY id)
SELECT id, CAST(n_out AS BIGINT) AS n_out, CAST(n_in AS BIGINT) AS n_in, CAST(n_out + n_in AS BIGINT) AS total FROM g ORDER BY total DESC, id LIMIT 30""")
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    return analysis.hotspots(fk_graph(spark, d))


@query(f"WITH {FK} SELECT id, lines, round(lines * 100.0::DOUBLE / (SELECT sum(lines) FROM n), 4) AS pct FROM n ORDER BY lines DESC, id LIMIT 30")
def size(spark: SparkSession, d: str) -> DataFrame:
    return analysis.size(fk_graph(spark, d))


@query(f"""WITH RECURSIVE {FK}, r AS (SELECT id, CAST(0 AS BIGINT) AS depth FROM n WHERE id NOT IN (SELECT dst FROM e)
UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 9)
SELECT n.id, coalesce(min(r.depth), -1) AS depth FROM n LEFT JOIN r USING (id) GROUP BY n.id""")
def layers(spark: SparkSession, d: str) -> DataFrame:
    return analysis.layers(fk_graph(spark, d))


@query(f"""WITH RECURSIVE {FK}, r AS (SELECT id, CAST(0 AS BIGINT) AS depth FROM n WHERE kind = 'customer' AND lines > 9900
UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.id WHERE r.depth < 9) SELECT id, min(depth) AS depth FROM r GROUP BY id""")
def diff(spark: SparkSession, d: str) -> DataFrame:
    g = fk_graph(spark, d)
    return analysis.diff(g, g.nodes.filter("kind = 'customer' AND lines > 9900").select("id"))


@query(f"""WITH {FK}, a AS (SELECT * FROM e WHERE src NOT LIKE 'order:%7'), na AS (SELECT id FROM n WHERE id NOT LIKE 'order:%7'), nb AS (SELECT id FROM n WHERE id NOT LIKE 'order:%3')
SELECT CASE WHEN na.id IS NULL THEN 'added' WHEN nb.id IS NULL THEN 'removed' ELSE 'common' END AS status, count(*) AS n FROM na FULL JOIN nb ON na.id = nb.id GROUP BY 1""")
def compare(spark: SparkSession, d: str) -> DataFrame:
    g = fk_graph(spark, d)
    without = lambda c: Graph(g.nodes.filter(~F.col("id").rlike(f"^order:.*{c}$")), g.edges)
    return analysis.compare(without(7), without(3))


@query(f"""WITH {FK}, x AS (SELECT id, sum(a) AS na, sum(b) AS nb FROM (SELECT src AS id, CAST(src NOT LIKE 'order:%7' AS INT) AS a, CAST(src NOT LIKE 'order:%3' AS INT) AS b FROM e
UNION ALL SELECT dst, CAST(src NOT LIKE 'order:%7' AS INT), CAST(src NOT LIKE 'order:%3' AS INT) FROM e) GROUP BY id)
SELECT id, CAST(nb - na AS BIGINT) AS delta FROM x WHERE nb <> na AND id NOT LIKE 'order:%' ORDER BY abs(nb - na) DESC, id LIMIT 20""")
def coupling_delta(spark: SparkSession, d: str) -> DataFrame:
    g = fk_graph(spark, d)
    without = lambda c: Graph(g.nodes.filter(~F.col("id").rlike(f"^order:.*{c}$")), g.edges.filter(~F.col("src").rlike(f"^order:.*{c}$")))
    return analysis.coupling_delta(without(7), without(3))


@query(f"""WITH {FK}, f AS (SELECT id, lines AS rank, length(id) AS chars FROM n WHERE kind = 'customer'),
s AS (SELECT id, chars, sum(chars + 1) OVER (ORDER BY rank DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM f)
SELECT id, chars, CAST(used AS BIGINT) AS used FROM s WHERE used <= 4000""")
def context(spark: SparkSession, d: str) -> DataFrame:
    g = fk_graph(spark, d)
    return analysis.context(g.nodes.filter("kind = 'customer'").select("id", F.col("lines").alias("rank"), F.length("id").cast("long").alias("chars")), 1000)


@query(f"""WITH {FK}, deg AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id),
m AS (SELECT (SELECT max(k) FROM deg)::DOUBLE / ((SELECT count(*) FROM n) - 1) AS c,
 (SELECT count(*) FROM (SELECT DISTINCT src FROM e) WHERE src NOT IN (SELECT dst FROM e))::DOUBLE / (SELECT count(*) FROM n) AS dd),
p AS (SELECT CAST(25 AS BIGINT) AS cycle_score, CAST(CASE WHEN c <= .4 THEN 25 WHEN c <= .6 THEN 20 WHEN c <= .8 THEN 15 WHEN c <= .95 THEN 8 ELSE 0 END AS BIGINT) AS coupling_score,
 CAST(CASE WHEN dd <= .05 THEN 25 WHEN dd <= .1 THEN 20 WHEN dd <= .2 THEN 15 WHEN dd <= .35 THEN 8 ELSE 0 END AS BIGINT) AS dead_score, CAST(15 AS BIGINT) AS complex_score FROM m),
s AS (SELECT *, cycle_score + coupling_score + dead_score + complex_score AS score FROM p)
SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 65 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'F' END AS grade FROM s""")
def health(spark: SparkSession, d: str) -> DataFrame:
    g = fk_graph(spark, d)
    cycles = analysis.circular(g).agg(F.count("*").alias("n"))
    return analysis.health(g, cycles, spark.sql("SELECT 0.15D AS share"))


@query(f"""WITH {FK} SELECT (row_number() OVER ()) - 1 AS step, id FROM (
SELECT unnest([a.src, a.dst, b.dst, c.dst]) AS id FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst WHERE a.src = 'order:5')""")
def why(spark: SparkSession, d: str) -> DataFrame:
    g = fk_graph(spark, d)
    region = g.edges.filter("src = 'order:5'").select(F.col("dst").alias("c"))
    for _ in range(2):
        region = region.join(g.edges, F.col("c") == F.col("src")).select(F.col("dst").alias("c"))
    return navigation.why(g.edges, "order:5", region.first()["c"])


_SIMPLE = f"""WITH RECURSIVE {TRADE}, p AS (SELECT src, dst, [src, dst] AS path FROM e WHERE src = 'n00' AND src <> dst
UNION ALL SELECT p.src, e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.dst WHERE p.dst <> 'n07' AND NOT list_contains(p.path, e.dst) AND len(p.path) <= %d)
SELECT CAST(len(path) - 1 AS BIGINT) AS length, array_to_string(path, '>') AS path FROM p WHERE dst = 'n07' ORDER BY len(path), array_to_string(path, '>') LIMIT %d"""


@query(_SIMPLE % (5, 20))
def simple_paths(spark: SparkSession, d: str) -> DataFrame:
    return navigation.paths(trade_graph(spark, d).edges, "n00", "n07", 5, 20)


@query(_SIMPLE % (5, 5))
def kshortest(spark: SparkSession, d: str) -> DataFrame:
    return paths.kshortest(trade_graph(spark, d), "n00", "n07", 5, 5)


@query(f"""WITH RECURSIVE {FK}, r AS (SELECT id FROM n WHERE contains(id, 'region:2') UNION
SELECT CASE WHEN e.src = r.id THEN e.dst ELSE e.src END FROM r JOIN e ON e.src = r.id OR e.dst = r.id) SELECT id FROM r""")
def subgraph(spark: SparkSession, d: str) -> DataFrame:
    return navigation.subgraph(fk_graph(spark, d), "region:2")


@query(f"""WITH {TRADE}, x AS (
SELECT b.src AS id, count(*)::DOUBLE / ((SELECT count(*) FROM e q WHERE q.src = b.src) + (SELECT count(*) FROM e q WHERE q.src = 'n05') - count(*)) AS j FROM e a JOIN e b ON a.dst = b.dst AND b.src <> 'n05' WHERE a.src = 'n05' GROUP BY b.src
UNION ALL SELECT b.dst, count(*)::DOUBLE / ((SELECT count(*) FROM e q WHERE q.dst = b.dst) + (SELECT count(*) FROM e q WHERE q.dst = 'n05') - count(*)) FROM e a JOIN e b ON a.src = b.src AND b.dst <> 'n05' WHERE a.dst = 'n05' GROUP BY b.dst)
SELECT id, round(sum(j) / 2, 6) AS score FROM x GROUP BY id ORDER BY score DESC, id LIMIT 20""")
def similar(spark: SparkSession, d: str) -> DataFrame:
    return navigation.similar(trade_graph(spark, d), "n05")


def _unrolled_pagerank(prefix: str, rounds: int = 20) -> str:
    r = [f"WITH {prefix}, od AS MATERIALIZED (SELECT src, count(*) AS od FROM e GROUP BY src), cnt AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM n), r0 AS MATERIALIZED (SELECT id, 1 / cnt.n AS r FROM n, cnt)"]
    for i in range(1, rounds + 1):
        r.append(f"""r{i} AS MATERIALIZED (SELECT n.id, 0.15 / cnt.n + 0.85 * (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM od)) / cnt.n + 0.85 * coalesce(s.v, 0) AS r
FROM n CROSS JOIN cnt LEFT JOIN (SELECT e.dst AS id, sum(p.r / od.od) AS v FROM e JOIN od ON od.src = e.src JOIN r{i - 1} p ON p.id = e.src GROUP BY 1) s ON s.id = n.id)""")
    return ",\n".join(r) + f" SELECT id, round(r * 1000, 6) AS score FROM r{rounds} ORDER BY score DESC, id LIMIT 30"


@query(_unrolled_pagerank(FK))
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    ranked = rank.pagerank(fk_graph(spark, d)).select("id", F.round(F.col("rank") * 1000, 6).alias("score"))
    return analysis.top(ranked, "score")


def _unrolled_hits(rounds: int = 20) -> str:
    r = [f"WITH {TRADE}, h0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS h, 1.0::DOUBLE AS a FROM n)"]
    for i in range(1, rounds + 1):
        r.append(f"""x{i} AS MATERIALIZED (SELECT n.id, coalesce((SELECT sum(p.a) FROM e JOIN h{i - 1} p ON p.id = e.dst WHERE e.src = n.id), 0) AS h,
coalesce((SELECT sum(p.h) FROM e JOIN h{i - 1} p ON p.id = e.src WHERE e.dst = n.id), 0) AS a FROM n),
h{i} AS MATERIALIZED (SELECT id, h / (SELECT sqrt(sum(h * h)) FROM x{i}) AS h, a / (SELECT sqrt(sum(a * a)) FROM x{i}) AS a FROM x{i})""")
    return ",\n".join(r) + f" SELECT id, round(h, 6) AS hub, round(a, 6) AS authority FROM h{rounds}"


@query(_unrolled_hits())
def hubs(spark: SparkSession, d: str) -> DataFrame:
    return rank.hits(trade_graph(spark, d)).select("id", F.round("hub", 6).alias("hub"), F.round("authority", 6).alias("authority"))


def _unrolled_power(rounds: int, alpha: float | None) -> str:
    start = "1.0::DOUBLE / (SELECT count(*) FROM n)" if alpha is None else "1.0::DOUBLE"
    r = [f"WITH {TRADE}, r0 AS MATERIALIZED (SELECT id, {start} AS x FROM n)"]
    for i in range(1, rounds + 1):
        flow = f"coalesce((SELECT sum(p.x) FROM e JOIN r{i - 1} p ON p.id = e.src WHERE e.dst = n.id), 0)"
        if alpha is None:
            r.append(f"y{i} AS MATERIALIZED (SELECT n.id, {flow} AS x FROM n), r{i} AS MATERIALIZED (SELECT id, x / (SELECT sqrt(sum(x * x)) FROM y{i}) AS x FROM y{i})")
        else:
            r.append(f"r{i} AS MATERIALIZED (SELECT n.id, {alpha} * {flow} + 1 AS x FROM n)")
    value = "x" if alpha is None else f"x / (SELECT sqrt(sum(x * x)) FROM r{rounds})"
    return ",\n".join(r) + f" SELECT id, round({value}, 4) AS score FROM r{rounds}"


@query(_unrolled_power(100, None))
def eigenvector(spark: SparkSession, d: str) -> DataFrame:
    return rank.power(trade_graph(spark, d), 100, None, 1e-9).select("id", F.round("score", 4).alias("score"))


@query(_unrolled_power(40, 0.1))
def katz(spark: SparkSession, d: str) -> DataFrame:
    return rank.power(trade_graph(spark, d), 1000, 0.1, 1e-7).select("id", F.round("score", 4).alias("score"))


_TROPHIC = ",\n".join(
    [f"WITH {FK}, k AS MATERIALIZED (SELECT id FROM n), ke AS MATERIALIZED (SELECT * FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS x FROM k)"]
    + [f"r{i} AS MATERIALIZED (SELECT k.id, 1 + coalesce(m.m, 0) AS x FROM k LEFT JOIN (SELECT ke.dst AS id, avg(p.x) AS m FROM ke JOIN r{i - 1} p ON p.id = ke.src GROUP BY 1) m ON m.id = k.id)" for i in range(1, 6)]
)


@query(_TROPHIC + " SELECT id, round(x, 6) AS score FROM r5")
def trophic(spark: SparkSession, d: str) -> DataFrame:
    return rank.trophic(fk_graph(spark, d)).select("id", F.round("score", 6).alias("score"))


@query()
def voterank(spark: SparkSession, d: str) -> DataFrame:
    return rank.voterank(trade_graph(spark, d))


_SCALE = "(SELECT 1.0::DOUBLE / ((count(*) - 1) * (count(*) - 2)) FROM n)"


@query(f"""WITH {PATHS}, b AS (SELECT a.v AS id, sum(a.sigma * b.sigma / w.sigma) AS t FROM sp a JOIN sp b ON b.s = a.v JOIN sp w ON w.s = a.s AND w.v = b.v
WHERE a.s <> a.v AND b.v <> a.v AND a.s <> b.v AND a.d + b.d = w.d GROUP BY a.v)
SELECT n.id, round(coalesce(t, 0) * {_SCALE}, 6) AS score FROM n LEFT JOIN b USING (id)""")
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    return centrality.betweenness(trade_graph(spark, d))


@query(f"""WITH {PATHS}, dg AS (SELECT id, count(*)::DOUBLE AS k FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id),
b AS (SELECT a.s, a.v AS id, sum(a.sigma * b.sigma / w.sigma) AS t FROM sp a JOIN sp b ON b.s = a.v JOIN sp w ON w.s = a.s AND w.v = b.v
WHERE a.s <> a.v AND b.v <> a.v AND a.s <> b.v AND a.d + b.d = w.d GROUP BY a.s, a.v),
q AS (SELECT b.id, sum(b.t * ds.k / greatest(1, (SELECT sum(k) FROM dg) - dv.k)) AS t FROM b JOIN dg ds ON ds.id = b.s JOIN dg dv ON dv.id = b.id GROUP BY b.id)
SELECT n.id, round(coalesce(t, 0), 6) AS score FROM n LEFT JOIN q USING (id)""")
def percolation(spark: SparkSession, d: str) -> DataFrame:
    return centrality.percolation(trade_graph(spark, d))


@query()
def load(spark: SparkSession, d: str) -> DataFrame:
    return centrality.load(trade_graph(spark, d))


@query(f"""WITH {PATHS} SELECT n.id, round(coalesce(r::DOUBLE / t * r / (SELECT count(*) - 1 FROM n), 0), 6) AS score FROM n LEFT JOIN (SELECT s AS id, count(*) AS r, sum(d) AS t FROM sp WHERE d > 0 GROUP BY s) USING (id)""")
def closeness(spark: SparkSession, d: str) -> DataFrame:
    return centrality.closeness(trade_graph(spark, d))


@query(f"WITH {PATHS} SELECT n.id, round(coalesce(h, 0) / (SELECT count(*) - 1 FROM n), 6) AS score FROM n LEFT JOIN (SELECT s AS id, sum(1.0::DOUBLE / d) AS h FROM sp WHERE d > 0 GROUP BY s) USING (id)")
def harmonic(spark: SparkSession, d: str) -> DataFrame:
    return centrality.harmonic(trade_graph(spark, d))


@query(f"WITH {PATHS} SELECT n.id, round(coalesce(h, 0)::DOUBLE / (SELECT count(*) - 1 FROM n), 6) AS score FROM n LEFT JOIN (SELECT s AS id, count(*) AS h FROM sp WHERE d > 0 GROUP BY s) USING (id)")
def reaching(spark: SparkSession, d: str) -> DataFrame:
    return centrality.reaching(trade_graph(spark, d))


@query(f"""WITH {PATHS} SELECT n.id, coalesce(t, 0)::DOUBLE AS score FROM n LEFT JOIN (SELECT a.v AS id, count(*) AS t FROM sp a JOIN sp b ON b.s = a.v JOIN sp w ON w.s = a.s AND w.v = b.v
WHERE a.s <> a.v AND b.v <> a.v AND a.s <> b.v AND a.d + b.d = w.d GROUP BY a.v) USING (id)""")
def current_flow(spark: SparkSession, d: str) -> DataFrame:
    return centrality.current_flow(trade_graph(spark, d))


_WALKS = ",\n".join(
    [f"WITH {TRADE}, w0 AS MATERIALIZED (SELECT id AS s, id AS x, 1.0::DOUBLE AS c FROM n)"] + [f"w{i} AS MATERIALIZED (SELECT w.s, u.y AS x, sum(w.c) AS c FROM w{i - 1} w JOIN u ON u.x = w.x GROUP BY 1, 2)" for i in range(1, 11)]
)


@query(_WALKS + " SELECT s AS id, round(sum(v), 6) AS score FROM (SELECT id AS s, 1.0::DOUBLE AS v FROM n" + "".join(f" UNION ALL SELECT s, c / {math.factorial(i)} FROM w{i} WHERE s = x" for i in range(1, 11)) + ") GROUP BY s")
def subgraph_centrality(spark: SparkSession, d: str) -> DataFrame:
    return centrality.subgraph_centrality(trade_graph(spark, d))


@query(f"""WITH {TRADE}, k AS (SELECT x, count(*)::DOUBLE AS k FROM u GROUP BY x),
t AS (SELECT a.x AS v, a.y AS u, (SELECT count(*) FROM u b JOIN u c ON c.x = a.x AND c.y = b.y WHERE b.x = a.y) AS common,
coalesce((SELECT sum(1 / kv.k * 1 / kw.k) FROM u p JOIN u q ON q.x = p.y AND q.y = a.y JOIN k kv ON kv.x = p.x JOIN k kw ON kw.x = q.x WHERE p.x = a.x), 0) AS q FROM u a)
SELECT v AS id, round(count(*) - sum(common / k.k), 6) AS effective, round(sum((1 / k.k + q) * (1 / k.k + q)), 6) AS constraint FROM t JOIN k ON k.x = t.v GROUP BY v""".replace("AS constraint", 'AS "constraint"'))
def structural_holes(spark: SparkSession, d: str) -> DataFrame:
    return centrality.structural_holes(trade_graph(spark, d))


@query(f"""WITH {TRADE} SELECT a.x AS id, count(*) AS n FROM u a JOIN u b ON a.x = b.x AND a.y < b.y
WHERE NOT EXISTS (SELECT 1 FROM u c WHERE c.x = a.y AND c.y = b.y) AND NOT EXISTS (SELECT 1 FROM u p JOIN u q ON p.y = q.y WHERE p.x = a.y AND q.x = b.y AND p.y <> a.x) GROUP BY a.x""")
def dispersion(spark: SparkSession, d: str) -> DataFrame:
    return centrality.dispersion(trade_graph(spark, d))


@query(f"""WITH {TRADE}, m AS (SELECT id FROM n WHERE kind = 'r2') SELECT (SELECT count(*) FROM m) AS members, (SELECT count(DISTINCT y) FROM u WHERE x IN (FROM m) AND y NOT IN (FROM m)) AS reached,
round((SELECT count(DISTINCT y) FROM u WHERE x IN (FROM m) AND y NOT IN (FROM m))::DOUBLE / ((SELECT count(*) FROM n) - (SELECT count(*) FROM m)), 6) AS share,
round((SELECT count(*) FROM u WHERE x IN (FROM m) AND y IN (FROM m))::DOUBLE / ((SELECT count(*) FROM m) * ((SELECT count(*) FROM m) - 1)), 6) AS cohesion""")
def group_centrality(spark: SparkSession, d: str) -> DataFrame:
    return centrality.group(trade_graph(spark, d), "r2")


@query()
def second_order(spark: SparkSession, d: str) -> DataFrame:
    return centrality.second_order(trade_graph(spark, d))


@query()
def current_flow_closeness(spark: SparkSession, d: str) -> DataFrame:
    return centrality.current_flow_closeness(trade_graph(spark, d))


@query(f"WITH {PATHS} SELECT v AS id, d FROM sp WHERE s = 'n03' ORDER BY d, v LIMIT 50")
def bellman_ford(spark: SparkSession, d: str) -> DataFrame:
    return paths.bellman_ford(trade_graph(spark, d), "n03")


@query(f"""WITH RECURSIVE {TRADE}, p AS (SELECT src, dst, [src, dst] AS path FROM e WHERE src = 'n00' AND src <> dst
UNION ALL SELECT p.src, e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.dst WHERE p.dst <> 'n07' AND NOT list_contains(p.path, e.dst) AND len(p.path) <= 6),
b AS (SELECT path FROM p WHERE dst = 'n07' ORDER BY len(path), path LIMIT 1)
SELECT CAST(generate_subscripts(path, 1) - 1 AS BIGINT) AS step, unnest(path) AS id FROM b""")
def astar(spark: SparkSession, d: str) -> DataFrame:
    return paths.astar(trade_graph(spark, d), "n00", "n07")


@query(f"WITH {PATHS}, x AS (SELECT s, max(d) AS e, count(*) AS n FROM sp WHERE d > 0 GROUP BY s) SELECT max(e) AS diameter, min(e) AS radius, CAST(sum(n) AS BIGINT) AS pairs FROM x")
def floyd_warshall(spark: SparkSession, d: str) -> DataFrame:
    return paths.floyd_warshall(trade_graph(spark, d))


@query(f"WITH {PATHS} SELECT d AS diameter, s, v FROM sp ORDER BY d DESC, s, v LIMIT 1")
def diameter(spark: SparkSession, d: str) -> DataFrame:
    return paths.diameter(trade_graph(spark, d))


@query()
def mst(spark: SparkSession, d: str) -> DataFrame:
    return paths.mst(trade_graph(spark, d))


@query(f"WITH {PATHS} SELECT a.s AS id, min(a.v) AS component FROM sp a JOIN sp b ON b.s = a.v AND b.v = a.s GROUP BY a.s")
def scc(spark: SparkSession, d: str) -> DataFrame:
    return paths.scc(trade_graph(spark, d))


@query(f"WITH {PATHS}, x AS (SELECT a.s AS id, min(a.v) AS component FROM sp a JOIN sp b ON b.s = a.v AND b.v = a.s GROUP BY a.s) SELECT component, count(*) AS n FROM x GROUP BY component HAVING count(*) > 1")
def circular(spark: SparkSession, d: str) -> DataFrame:
    return analysis.circular(trade_graph(spark, d))


@query(f"""WITH RECURSIVE {FK}, r AS (SELECT id, CAST(0 AS BIGINT) AS level FROM n WHERE id NOT IN (SELECT dst FROM e)
UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.id) SELECT id, max(level) AS level FROM r GROUP BY id""")
def topo_sort(spark: SparkSession, d: str) -> DataFrame:
    return paths.topo_sort(fk_graph(spark, d))


@query(f"WITH {TRADE} SELECT a.x AS a, a.y AS b, b.y AS c FROM u a JOIN u b ON b.x = a.y AND b.y > a.y JOIN u c ON c.x = a.x AND c.y = b.y WHERE a.x < a.y")
def triangles(spark: SparkSession, d: str) -> DataFrame:
    return paths.triangles(trade_graph(spark, d))


@query(f"""WITH {TRADE} SELECT a.x AS n1, a.y AS n2, b.y AS n3 FROM u a JOIN u b ON b.x = a.y AND b.y <> a.x JOIN n p ON p.id = a.x AND p.kind = 'r0' JOIN n q ON q.id = a.y AND q.kind = 'r1' JOIN n r ON r.id = b.y AND r.kind = 'r2'
ORDER BY 1, 2, 3 LIMIT 100""")
def subgraph_iso(spark: SparkSession, d: str) -> DataFrame:
    return paths.subgraph_iso(trade_graph(spark, d), ["r0", "r1", "r2"])


_LINKS = f"""WITH {SUPPLY}, k AS MATERIALIZED (SELECT x, count(*) AS k FROM u GROUP BY x),
w AS MATERIALIZED (SELECT a.x AS a, b.y AS b, count(*) AS common, sum(CASE WHEN k.k > 1 THEN 1 / ln(k.k) ELSE 0 END) AS aa FROM u a JOIN u b ON b.x = a.y AND a.x < b.y JOIN k ON k.x = a.y GROUP BY 1, 2),
s AS (SELECT a, b, common, round(common::DOUBLE / (ka.k + kb.k - common), 6) AS jaccard, round(aa, 6) AS adamic_adar FROM w JOIN k ka ON ka.x = a JOIN k kb ON kb.x = b
 WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.x = a AND u.y = b))
SELECT a, b, %s AS score FROM s ORDER BY score DESC, a, b LIMIT 30"""


@query(_LINKS % "common")
def common_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return links.top_links(supply_graph(spark, d), "common")


@query(_LINKS % "jaccard")
def jaccard(spark: SparkSession, d: str) -> DataFrame:
    return links.top_links(supply_graph(spark, d), "jaccard")


@query(_LINKS % "adamic_adar")
def adamic_adar(spark: SparkSession, d: str) -> DataFrame:
    return links.top_links(supply_graph(spark, d), "adamic_adar")


@query(f"""WITH {FK}, p AS (SELECT a.src AS n1, a.dst AS n2, b.dst AS n3, c.dst AS n4 FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst WHERE a.src LIKE 'order:%' AND a.dst LIKE 'customer:%' AND b.dst LIKE 'nation:%' AND c.dst LIKE 'region:%')
SELECT unnest([1, 2, 3, 4])::BIGINT AS position, unnest([count(DISTINCT n1), count(DISTINCT n2), count(DISTINCT n3), count(DISTINCT n4)]) AS distinct_nodes, unnest([count(*), count(*), count(*), count(*)]) AS paths FROM p""")
def meta_path(spark: SparkSession, d: str) -> DataFrame:
    return links.meta_path_counts(links.meta_path(fk_graph(spark, d), ["order", "customer", "nation", "region"]))


@query(f"""WITH RECURSIVE {FK}, r AS (SELECT id AS label, id FROM n WHERE kind IN ('region') UNION SELECT r.label, e.src FROM r JOIN e ON e.dst = r.id)
SELECT min(id) AS label, count(*) AS n FROM r GROUP BY r.label""")
def islands(spark: SparkSession, d: str) -> DataFrame:
    return community.islands(fk_graph(spark, d))


@query()
def clusters_lpa(spark: SparkSession, d: str) -> DataFrame:
    return community.label_propagation(trade_graph(spark, d))


@query()
def k_core(spark: SparkSession, d: str) -> DataFrame:
    return community.k_core(trade_graph(spark, d))


@query()
def k_clique(spark: SparkSession, d: str) -> DataFrame:
    return community.triangle_communities(trade_graph(spark, d))


@query(f"""WITH {TRADE} SELECT round(count(*) FILTER (WHERE a.kind = b.kind)::DOUBLE / count(*) - (SELECT sum(k * k) FROM (SELECT n.kind, count(*)::DOUBLE AS k FROM u JOIN n ON n.id = u.x GROUP BY 1)) / (count(*) * count(*)), 6) AS q
FROM u JOIN n a ON a.id = u.x JOIN n b ON b.id = u.y""")
def modularity(spark: SparkSession, d: str) -> DataFrame:
    g = trade_graph(spark, d)
    return community.modularity(g, g.nodes.select("id", F.col("kind").alias("label")))


@query(f"WITH {PATHS} SELECT s, count(*) AS n FROM sp WHERE d > 0 GROUP BY s")
def closure_sizes(spark: SparkSession, d: str) -> DataFrame:
    g = trade_graph(spark, d)
    return loops.closure(g.edges, g.nodes).filter("s <> v").groupBy("s").agg(F.count("*").alias("n"))


@query("SELECT kind, count(*) AS n FROM (SELECT 'part' AS kind FROM part UNION ALL SELECT 'supplier' FROM supplier) GROUP BY kind")
def census(spark: SparkSession, d: str) -> DataFrame:
    both = read(spark, d, "part").select(F.lit("part").alias("kind")).union(read(spark, d, "supplier").select(F.lit("supplier")))
    return both.groupBy("kind").agg(F.count("*").alias("n"))
