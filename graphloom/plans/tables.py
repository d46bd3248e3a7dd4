"""Graphs and relations drawn from the star-schema tables, and the same as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.graph import Graph
from graphloom.session import parts


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def fk_graph(spark: SparkSession, d: str) -> Graph:
    """Rows as nodes (kind = table), foreign keys as edges; ``lines`` is a size taken from a number."""
    t = lambda n: read(spark, d, n)
    whole = lambda c: F.floor(F.abs(F.col(c))).cast("long").alias("lines")
    nodes = (
        t("region").select(_id("region", "r_regionkey").alias("id"), F.lit("region").alias("kind"), F.col("r_regionkey").cast("long").alias("lines"))
        .union(t("nation").select(_id("nation", "n_nationkey"), F.lit("nation"), F.col("n_nationkey").cast("long")))
        .union(t("customer").select(_id("customer", "c_custkey"), F.lit("customer"), whole("c_acctbal")))
        .union(t("supplier").select(_id("supplier", "s_suppkey"), F.lit("supplier"), whole("s_acctbal")))
        .union(t("orders").select(_id("order", "o_orderkey"), F.lit("order"), whole("o_totalprice")))
    )
    edges = (
        t("nation").select(_id("nation", "n_nationkey").alias("src"), _id("region", "n_regionkey").alias("dst"))
        .union(t("customer").select(_id("customer", "c_custkey"), _id("nation", "c_nationkey")))
        .union(t("supplier").select(_id("supplier", "s_suppkey"), _id("nation", "s_nationkey")))
        .union(t("orders").select(_id("order", "o_orderkey"), _id("customer", "o_custkey")))
    )
    return Graph(nodes, edges)


def trade_graph(spark: SparkSession, d: str, k: int = 4) -> Graph:
    """Nations; each points at the k other nations that buy most of its suppliers' lines."""
    lines = read(spark, d, "lineitem").select("l_suppkey", "l_orderkey")
    sold = lines.join(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    bought = read(spark, d, "orders").select("o_orderkey", "o_custkey").join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    pairs = sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("c")).filter("s_nationkey <> c_nationkey")
    w = Window.partitionBy("s_nationkey").orderBy(F.col("c").desc(), "c_nationkey")
    name = lambda c: F.concat(F.lit("n"), F.lpad(F.col(c).cast("string"), 2, "0"))
    edges = pairs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select(name("s_nationkey").alias("src"), name("c_nationkey").alias("dst"))
    nodes = read(spark, d, "nation").select(name("n_nationkey").alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("kind"), F.lit(1).cast("long").alias("lines"))
    return Graph(nodes, edges)


def supply_graph(spark: SparkSession, d: str) -> Graph:
    """Parts and suppliers linked by order lines."""
    keys = read(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    e = keys.distinct().select(_id("part", "l_partkey").alias("src"), _id("supplier", "l_suppkey").alias("dst"))
    ids = keys.select("l_partkey").distinct().select(_id("part", "l_partkey").alias("id")).union(keys.select("l_suppkey").distinct().select(_id("supplier", "l_suppkey")))
    return Graph(ids.select("id", F.split_part("id", F.lit(":"), F.lit(1)).alias("kind"), F.lit(1).cast("long").alias("lines")), e)


def commits(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commits of the suppliers on their lines."""
    t = read(spark, d, "lineitem")
    n = parts(t)
    lines = t.select("l_orderkey", "l_suppkey").repartition(n, "l_orderkey").select("l_orderkey", _id("supplier", "l_suppkey").alias("file"))
    orders = read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts")).repartition(n, "o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("commit"), "ts", "file")


def functions(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as functions of their supplier."""
    t = read(spark, d, "lineitem")
    return t.select(
        _id("supplier", "l_suppkey").alias("file"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"),
        (F.col("l_linenumber") * 10).cast("long").alias("start_line"),
        (F.col("l_linenumber") * 10 + F.pmod("l_orderkey", F.lit(7))).cast("long").alias("end_line"),
        (F.col("l_returnflag") == "R").alias("is_exported"),
        F.pmod("l_orderkey", F.lit(3)).cast("long").alias("n_params"),
    )


def calls(spark: SparkSession, d: str) -> DataFrame:
    """A line calls the parts of the same order's other lines."""
    t = read(spark, d, "lineitem")
    t = t.select("l_orderkey", "l_suppkey", "l_partkey").repartition(parts(t), "l_orderkey")
    a = t.toDF("o", "s", "p")
    b = t.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("q"))
    return a.join(b, "o").filter("p <> q").select(_id("supplier", "s").alias("file"), F.concat(F.lit("p"), F.col("p").cast("string")).alias("name"), F.concat(F.lit("p"), F.col("q").cast("string")).alias("callee"))


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as text files."""
    t = read(spark, d, "documents")
    return t.select(F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), F.col("text").alias("content"))


FK = """
n AS MATERIALIZED (
  SELECT 'region:' || r_regionkey AS id, 'region' AS kind, CAST(r_regionkey AS BIGINT) AS lines FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', CAST(n_nationkey AS BIGINT) FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', CAST(floor(abs(c_acctbal)) AS BIGINT) FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', CAST(floor(abs(s_acctbal)) AS BIGINT) FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'order', CAST(floor(abs(o_totalprice)) AS BIGINT) FROM orders),
e AS MATERIALIZED (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders)"""

TRADE = """
tc AS (SELECT s_nationkey AS a, c_nationkey AS b, count(*) AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
e AS MATERIALIZED (SELECT 'n' || lpad(CAST(a AS VARCHAR), 2, '0') AS src, 'n' || lpad(CAST(b AS VARCHAR), 2, '0') AS dst FROM (
  SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM tc) WHERE r <= 4),
n AS MATERIALIZED (SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS id, 'r' || n_regionkey AS kind FROM nation),
u AS MATERIALIZED (SELECT DISTINCT x, y FROM (SELECT src AS x, dst AS y FROM e UNION ALL SELECT dst, src FROM e) WHERE x <> y)"""

#: Shortest paths between all pairs of the trade graph: sp(s, v, d, sigma). Depth is bounded by its 25 nodes.
PATHS = TRADE + """,
""" + ",\n".join(
    ["f0 AS MATERIALIZED (SELECT id AS s, id AS v, CAST(0 AS BIGINT) AS d, 1.0::DOUBLE AS sigma FROM n)", "a0 AS MATERIALIZED (SELECT * FROM f0)"]
    + [
        f"""f{i} AS MATERIALIZED (SELECT f.s, e.dst AS v, CAST({i} AS BIGINT) AS d, sum(f.sigma) AS sigma FROM f{i - 1} f JOIN e ON e.src = f.v
  WHERE NOT EXISTS (SELECT 1 FROM a{i - 1} a WHERE a.s = f.s AND a.v = e.dst) GROUP BY 1, 2),
a{i} AS MATERIALIZED (SELECT * FROM a{i - 1} UNION ALL SELECT * FROM f{i})"""
        for i in range(1, 13)
    ]
) + ",\nsp AS MATERIALIZED (SELECT * FROM a12)"

SUPPLY = """
e AS MATERIALIZED (SELECT DISTINCT 'part:' || l_partkey AS src, 'supplier:' || l_suppkey AS dst FROM lineitem),
n AS MATERIALIZED (SELECT id, split_part(id, ':', 1) AS kind FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)),
u AS MATERIALIZED (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e)"""

COMMITS = """
cm AS MATERIALIZED (SELECT l_orderkey AS "commit", o_orderdate AS ts, 'supplier:' || l_suppkey AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

FUNCTIONS = """
fn AS MATERIALIZED (SELECT 'supplier:' || l_suppkey AS file, 'p' || l_partkey AS name, CAST(l_linenumber * 10 AS BIGINT) AS start_line,
  CAST(l_linenumber * 10 + l_orderkey % 7 AS BIGINT) AS end_line, l_returnflag = 'R' AS is_exported, CAST(l_orderkey % 3 AS BIGINT) AS n_params
  FROM lineitem),
ca AS MATERIALIZED (SELECT 'supplier:' || a.l_suppkey AS file, 'p' || a.l_partkey AS name, 'p' || b.l_partkey AS callee
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey)"""

FILES = """
fl AS (SELECT source || '/' || doc_id || '.' || lang AS path, text AS content FROM documents),
ln AS (SELECT path, generate_subscripts(x, 1) AS line, unnest(x) AS text FROM (SELECT path, string_split(content, chr(10)) AS x FROM fl))"""
