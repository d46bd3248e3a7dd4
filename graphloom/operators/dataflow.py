"""Code property graphs and slices over them.

Input relations, one row a fact: ``definitions`` and ``uses`` (file, scope, name, line),
``call_args`` (file, scope, line, callee, position, name), ``returns`` (file, scope, line,
name). Nodes are (id, kind, file, line, name, scope), edges (src, dst, kind).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom import loops

MODULE = "__module__"
#: (pattern, category, role); a pattern matches a callee that equals it or ends with it after a dot.
DEFAULT_RULES = [
    ("fetch", "network", "sink"), ("axios", "network", "sink"), ("requests.get", "network", "sink"), ("requests.post", "network", "sink"),
    ("eval", "exec", "sink"), ("exec", "exec", "sink"), ("system", "exec", "sink"), ("subprocess.*", "exec", "sink"), ("popen", "exec", "sink"),
    ("open", "filesystem", "sink"), ("writeFile", "filesystem", "sink"), ("unlink", "filesystem", "sink"),
    ("query", "database", "sink"), ("execute", "database", "sink"), ("raw", "database", "sink"),
    ("input", "user-input", "source"), ("req.body", "user-input", "source"), ("getenv", "config", "source"), ("readFile", "file-read", "source"),
    ("escape", "sanitizer", "sanitizer"), ("sanitize", "sanitizer", "sanitizer"),
]


def _node(kind: str, name: str) -> Column:
    return F.concat_ws(":", F.lit(kind), "file", "scope", name, F.col("line").cast("string"))


def cpg(definitions: DataFrame, uses: DataFrame, call_args: DataFrame, returns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: def to use, argument to call, call to the definition it feeds, return."""
    cols = lambda df, kind, name: df.select(_node(kind, name).alias("id"), F.lit(kind).alias("kind"), "file", "line", F.col(name).alias("name"), "scope")
    nodes = cols(definitions, "def", "name").union(cols(uses, "use", "name")).union(cols(call_args, "call", "callee")).union(cols(returns, "return", "name")).distinct()
    d, u = nodes.filter("kind = 'def'"), nodes.filter("kind = 'use'")
    # as-of: the latest definition at or above the use, in the function's scope before the module's
    met = u.select(F.col("id").alias("use"), "file", "scope", "name", F.col("line").alias("at")).join(
        d.select(F.col("id").alias("def"), "file", F.col("scope").alias("ds"), "name", "line"), ["file", "name"]
    )
    met = met.filter("line <= at AND (ds = scope OR ds = '__module__')")
    best = Window.partitionBy("use").orderBy((F.col("ds") != F.col("scope")).cast("int"), F.col("line").desc(), "def")
    def_use = met.withColumn("r", F.row_number().over(best)).filter("r = 1").select(F.col("def").alias("src"), F.col("use").alias("dst"), F.lit("data").alias("kind"))
    args = call_args.select(_node("use", "name").alias("src"), _node("call", "callee").alias("dst"), F.lit("call").alias("kind"))
    feeds = call_args.select(_node("call", "callee").alias("src"), "file", "scope", "line").distinct()
    feeds = feeds.join(d.select(F.col("id").alias("dst"), "file", "scope", "line"), ["file", "scope", "line"]).select("src", "dst", F.lit("data").alias("kind"))
    back = u.select(F.col("id").alias("src"), "file", "scope", "line", "name").join(nodes.filter("kind = 'return'").select(F.col("id").alias("dst"), "file", "scope", "line", "name"), ["file", "scope", "line", "name"])
    return nodes, def_use.union(args).union(feeds).union(back.select("src", "dst", F.lit("return"))).distinct()


def resolve(nodes: DataFrame, target: str) -> DataFrame:
    """(id): nodes of ``file:line``, ``file:name`` or ``name``."""
    file, _, last = target.rpartition(":")
    if not file:
        return nodes.filter(F.col("name") == target).select("id")
    own = nodes.filter((F.col("file") == file) | F.col("file").endswith(file))
    return (own.filter(F.col("line") == int(last)) if last.isdigit() else own.filter(F.col("name") == last)).select("id")


def slice_back(edges: DataFrame, seeds: DataFrame, hops: int = 20) -> DataFrame:
    """(id, depth): what flows into the seeds."""
    return loops.bfs(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds, hops)


def trace_value(edges: DataFrame, seeds: DataFrame, hops: int = 20) -> DataFrame:
    """(id, depth): where the seeds flow to."""
    return loops.bfs(edges, seeds, hops)


def taint(edges: DataFrame, sources: DataFrame, sinks: DataFrame, hops: int = 20, sanitizers: DataFrame | None = None) -> DataFrame:
    """(id): nodes on flows from sources to sinks; flows may be stopped at sanitizers (id)."""
    if sanitizers is not None:
        edges = edges.join(sanitizers.select(F.col("id").alias("src")), "src", "left_anti")
    return trace_value(edges, sources, hops).select("id").intersect(slice_back(edges, sinks, hops).select("id"))


def sinks(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, name, category): calls that match a rule (pattern, category, role) with role sink."""
    calls = nodes.filter("kind = 'call'")
    r = F.broadcast(rules.filter("role = 'sink'").select("pattern", "category"))
    stem = F.regexp_replace("pattern", r"\.\*$", "")
    exact = (F.col("name") == F.col("pattern")) | F.col("name").endswith(F.concat(F.lit("."), F.col("pattern")))
    wild = F.col("pattern").endswith(".*") & (F.col("name").startswith(F.concat(stem, F.lit("."))) | F.col("name").contains(F.concat(F.lit("."), stem, F.lit("."))))
    return calls.join(r, exact | wild).select("id", "name", "category").distinct()


def data_flow(nodes: DataFrame, edges: DataFrame, scope: str) -> DataFrame:
    """(id, kind, line, flows_to): a function's nodes with their outgoing edges."""
    own = nodes.filter(F.col("scope") == scope).select("id", "kind", "line")
    return own.join(edges.select(F.col("src").alias("id"), F.col("dst").alias("flows_to")), "id", "left")


CALL_KINDS = ("ffi_call", "dispatch_call", "cuda_launch", "triton_launch", "torch_op_call")
REGISTRATION_KINDS = ("pybind", "torch_library", "triton_kernel", "cuda_kernel", "yaml_dispatch", "dispatch_registration")
GPU_KINDS = ("triton_kernel", "cuda_kernel")


def bridges(table: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of the bridge table (file, kind, name, target, line, namespace), of some kinds."""
    return table if kinds is None else table.filter(F.col("kind").isin(*kinds))


def dispatch_map(table: DataFrame) -> DataFrame:
    """(name, namespace, target, line): what each operation dispatches to."""
    return bridges(table, ("torch_library", "yaml_dispatch")).select("name", "namespace", "target", "line")


def bridge_edges(table: DataFrame) -> DataFrame:
    """(src, dst): files that call a name to the files that register it."""
    a = bridges(table, CALL_KINDS).select(F.col("file").alias("src"), "name")
    b = bridges(table, REGISTRATION_KINDS).select(F.col("file").alias("dst"), "name")
    return a.join(b, "name").filter("src <> dst").select("src", "dst").distinct()
