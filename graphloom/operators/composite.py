"""Reports that are put together from other analyses."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import analysis, functions
from graphloom.session import cut


def summary(g: Graph, calls: DataFrame, health: DataFrame, k: int = 5) -> DataFrame:
    """(section, name, n): totals, the files with most edges, the functions (name, callee) called most, the grade."""
    totals = analysis.stats(g).filter("section = 'total'")
    coupled = analysis.hotspots(g, k).select(F.lit("coupled").alias("section"), F.col("id").alias("name"), F.col("total").alias("n"))
    called = analysis.top(calls.groupBy(F.col("callee").alias("id")).agg(F.count("*").alias("n")), "n", k)
    called = called.select(F.lit("called").alias("section"), F.col("id").alias("name"), "n")
    grade = health.select(F.lit("health").alias("section"), F.col("grade").alias("name"), F.col("score").cast("long").alias("n"))
    return totals.select("section", "name", "n").union(coupled).union(called).union(grade)


def validate(g: Graph, cycles: DataFrame, health: DataFrame, secrets: DataFrame, least: int = 60, dead_share: float = 0.1) -> DataFrame:
    """(check, value, passed): grade, cycles, dead files and critical secrets; the last row holds all of them."""
    one = lambda name, value, passed: health.sparkSession.range(1).select(F.lit(name).alias("check")).crossJoin(value).select("check", F.col("value").cast("double").alias("value"), F.expr(passed).alias("passed"))  # noqa: E731  one row each
    score = health.select(F.col("score").alias("value"))
    n_cycles = cycles.agg(F.count("*").alias("value"))
    share = analysis.dead_files(g).agg(F.count("*").alias("dead")).crossJoin(g.nodes.agg(F.count("*").alias("n"))).select((F.col("dead") / F.greatest("n", F.lit(1))).alias("value"))
    critical = secrets.filter("severity = 'critical'").agg(F.count("*").alias("value"))
    # the last row is taken from the four others as they are, not from what they are made of
    rows = one("health", score, f"value >= {least}").union(one("cycles", n_cycles, "value = 0")).union(one("dead_files", share, f"value < {dead_share}")).union(one("secrets", critical, "value = 0"))
    rows = cut(rows)
    return rows.union(rows.agg(F.lit("all").alias("check"), F.sum(F.col("passed").cast("double")).alias("value"), F.bool_and("passed").alias("passed")))


def changeset(g: Graph, changed: DataFrame, old: DataFrame, new: DataFrame, commits: DataFrame, k: int = 10) -> DataFrame:
    """(section, name, n): risk, files changed and reached, functions (file, name, n_params) by status, files with most churn."""
    score = functions.risk(g, changed).select(F.lit("risk").alias("section"), F.col("level").alias("name"), F.col("score").cast("long").alias("n"))
    reach = analysis.diff(g, changed).agg(F.count_if(F.col("depth") == 0).alias("changed"), F.count_if(F.col("depth") > 0).alias("reached"))
    reach = reach.select(F.explode(F.array(F.struct(F.lit("changed").alias("name"), F.col("changed").alias("n")), F.struct(F.lit("reached").alias("name"), F.col("reached").alias("n")))).alias("r")).select(F.lit("files").alias("section"), "r.name", "r.n")
    moved = functions.diff_functions(old, new).groupBy("status").agg(F.count("*").alias("n")).select(F.lit("functions").alias("section"), F.col("status").alias("name"), "n")
    ends = g.edges.select(F.col("src").alias("file")).union(g.edges.select("dst")).groupBy("file").agg(F.count("*").alias("coupling"))
    busy = functions.churn(commits, ends, k).select(F.lit("churn").alias("section"), F.col("file").alias("name"), F.col("risk").alias("n"))
    return score.union(reach).union(moved).union(busy)


def handoff(g: Graph, calls: DataFrame, health: DataFrame, files: DataFrame, budget: int = 8000, k: int = 10) -> DataFrame:
    """(section, name, n): stats, grade, nodes per layer, coupled files, the summary, and the headers (id, rank, chars) within a budget of tokens."""
    health = cut(health)
    whole = analysis.stats(g).select(F.concat(F.lit("stats "), "section").alias("section"), "name", "n")
    grade = health.select(F.lit("health").alias("section"), F.col("grade").alias("name"), F.col("score").cast("long").alias("n"))
    depth = analysis.layers(g).groupBy("depth").agg(F.count("*").alias("n")).select(F.lit("layer").alias("section"), F.col("depth").cast("string").alias("name"), "n")
    coupled = analysis.hotspots(g, k).select(F.lit("key file").alias("section"), F.col("id").alias("name"), F.col("total").alias("n"))
    board = summary(g, calls, health).select(F.concat(F.lit("summary "), "section").alias("section"), "name", "n")
    headers = analysis.context(files, budget).select(F.lit("map").alias("section"), F.col("id").alias("name"), F.col("chars").cast("long").alias("n"))
    return whole.union(grade).union(depth).union(coupled).union(board).union(headers)


def audit(g: Graph, betweenness: DataFrame, holes: DataFrame, communities: DataFrame, k: int = 10, clusters: int = 3) -> DataFrame:
    """(section, name, value): the k chokepoints (id, score) and brokers (id, effective), what is both, the largest communities, nodes by kind.

    Nodes of score 0 are no chokepoints, communities of one node none.
    """
    choke = analysis.top(betweenness.filter("score > 0").select("id", F.col("score").alias("value")), "value", k)
    broker = analysis.top(holes.select("id", F.col("effective").alias("value")), "value", k)
    both = choke.join(broker.select("id"), "id", "left_semi")
    sizes = communities.groupBy(F.col("community").alias("id")).agg(F.count("*").cast("double").alias("value")).filter("value > 1")
    kinds = g.nodes.groupBy(F.col("kind").alias("id")).agg(F.count("*").cast("double").alias("value"))
    rows = [("chokepoint", choke), ("broker", broker), ("risk", both), ("cluster", analysis.top(sizes, "value", clusters)), ("kind", kinds)]
    return reduce(DataFrame.union, (r.select(F.lit(s).alias("section"), F.col("id").alias("name"), "value") for s, r in rows))


def run_steps(actions: dict[str, Callable[[str], DataFrame]], steps: list[tuple[str, str]]) -> list[tuple[str, DataFrame]]:
    """Run (action, target) steps in order; the first error ends the run and names its step."""
    out = []
    for k, (name, target) in enumerate(steps, 1):
        if name not in actions:
            raise ValueError(f"step {k}: unknown action {name}")
        try:
            out.append((name, actions[name](target)))
        except Exception as e:
            raise RuntimeError(f"step {k}, {name}: {e}") from e
    return out


def parse_steps(text: str) -> list[tuple[str, str]]:
    """Comma-separated ``action`` or ``action:target`` steps."""
    parts = (p.strip().partition(":") for p in text.split(","))
    return [(name.strip(), target.strip()) for name, _, target in parts if name]


# The intents in the order in which they are tried, and the words that name them.
INTENTS = [
    ("android_apk", ["apk", "android app", ".apk", "android binary"]),
    ("reverse_pe", [".exe", ".dll", "windows binary", "pe binary", "reverse pe", "reverse a windows"]),
    ("reverse_elf", [".so ", '.so"', ".so'", "elf binary", "linux binary", "reverse elf", "reverse a linux"]),
    ("reverse_macho", [".dylib", "macho", "mach-o", "mac binary", "reverse a mac"]),
    ("ml_model", [".gguf", ".onnx", ".safetensors", "ml model", "model architecture", "tensors", "onnx graph", "neural network"]),
    ("web_recon", ["recon", "website", "passive recon", "fingerprint site", "web stack", ".har", "sitemap", "crt.sh", "robots.txt"]),
    ("find_endpoints", ["endpoint", "routes", "api surface", "what apis", "rest api"]),
    ("find_secrets", ["secrets", "credentials", "leaked keys", "api keys", "password leak"]),
    ("security_review", ["security review", "security audit", "security check", "security pass"]),
    ("supply_chain", ["supply chain", "sbom", "license scan", "dependencies report", "vulnerable deps", "cve", "spdx", "cyclonedx"]),
    ("dead_code", ["dead code", "unused", "cleanup", "dead files", "dead deps"]),
    ("hotspots", ["hotspot", "churn", "active files", "recently changed", "git history"]),
    ("load_bearing", ["load bearing", "load-bearing", "critical files", "important files", "bottleneck", "chokepoint"]),
    ("graph_layout", ["dot", "mermaid", "gephi", "visualize", "render graph", "graph layout"]),
    ("codebase_audit", ["audit", "review codebase", "code review", "review the code", "analyze codebase", "overview of the codebase"]),
    ("structure", ["structure", "what is this", "what does this do", "summarize", "high-level overview", "what's in this repo", "explain"]),
]
# Words that name a comparison of two files, tried after the first intent; its steps need both paths.
DIFF_WORDS = ["diff", "compare two", "compare binaries", "what changed between"]
# The actions of each intent.
INTENT_STEPS = {
    "android_apk": ["apk-info"],
    "diff_binaries": ["binary-diff"],
    "reverse_pe": ["pe-meta", "pe-imports", "pe-exports", "pe-strings", "pe-sections", "pe-debug", "bin-disasm"],
    "reverse_elf": ["elf-info", "bin-disasm"],
    "reverse_macho": ["macho-info"],
    "ml_model": ["gguf-info", "pagerank:tensor"],
    "web_recon": ["web-dom", "web-fingerprint"],
    "find_endpoints": ["api-surface", "meta-path:source->endpoint"],
    "find_secrets": ["secret-scan", "pagerank:secret"],
    "security_review": ["secret-scan", "dep-tree", "dead-deps", "api-surface"],
    "supply_chain": ["license-scan", "dep-tree", "dead-deps"],
    "dead_code": ["dead-files", "dead-functions", "dead-deps"],
    "hotspots": ["hotspots", "churn", "git-coupling"],
    "load_bearing": ["audit", "betweenness", "bridges"],
    "graph_layout": ["dot"],
    "codebase_audit": ["audit", "summary"],
    "structure": ["structure", "summary", "layers"],
    "fallback": [],
}


def intent_of(goal: Column, n_paths: Column) -> Column:
    """The first intent that a goal names. Two paths or more make a comparison; other goals with its words go on."""
    g = F.lower(goal)
    names = lambda words: reduce(lambda a, b: a | b, [g.contains(w) for w in words])
    first, *rest = INTENTS
    out = F.when(names(first[1]), first[0]).when(names(DIFF_WORDS) & (n_paths >= 2), "diff_binaries")
    for intent, words in rest:
        hit = names(words) | g.endswith(".so") if intent == "reverse_elf" else names(words)
        out = out.when(hit, intent)
    return out.otherwise("fallback")


def think(goals: DataFrame) -> DataFrame:
    """(goal, intent, steps) of goals (goal, paths ARRAY<STRING>): what to run for each.

    A goal with a live URL is refused (intent ``rejected``), as nothing here opens
    connections; an empty one too. Null goals count as empty.
    """
    table = F.create_map(*(c for intent, steps in INTENT_STEPS.items() for c in (F.lit(intent), F.array(*map(F.lit, steps)).cast("array<string>"))))
    goal, none = F.coalesce("goal", F.lit("")), F.array().cast("array<string>")
    refused = (F.trim(goal) == "") | goal.rlike(r"(^|\s)https?://")
    out = goals.select(goal.alias("goal"), F.when(refused, "rejected").otherwise(intent_of(goal, F.size(F.coalesce("paths", none)))).alias("intent"))
    return out.withColumn("steps", F.coalesce(F.try_element_at(table, F.col("intent")), none))
