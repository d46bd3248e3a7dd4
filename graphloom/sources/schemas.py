"""Readers of schema texts: Protocol Buffers, GraphQL, Compose files, Terraform.

Texts (path, content) go in; each file is parsed on its own in ``mapInPandas``, as nested
blocks are beyond regular expressions. Null contents give no rows, broken ones what can
be read up to the break.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import loops
from graphloom.graph import Graph
from graphloom.operators.paths import topo_sort

# Scalar types of the languages, which are no references.
PROTO_SCALARS = set("double float int32 int64 uint32 uint64 sint32 sint64 fixed32 fixed64 sfixed32 sfixed64 bool string bytes".split())
GRAPHQL_SCALARS = set("Int Float String Boolean ID".split())
# Kinds of blocks at the top of a Terraform file, and how many labels name one.
TERRAFORM_LABELS = {"resource": 2, "data": 2, "module": 1, "variable": 1, "output": 1, "provider": 1, "locals": 0, "terraform": 0}


def _each(files: DataFrame, parse: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    names = ["path", *(c.split()[0] for c in schema.split(", "))]

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, text in part[["path", "content"]].itertuples(index=False):
                if isinstance(text, str):
                    yield pd.DataFrame([(path, *row) for row in parse(text)], columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(read, f"path string, {schema}")


def blocks(text: str, quotes: str = '"') -> Iterator[tuple[str, str]]:
    """(head, body) of the braces at the top of a text; braces within quotes do not count, an open end closes with the text."""
    depth, start, head, quote, i = 0, 0, "", "", 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in quotes:
            quote = c
        elif c == "{":
            if not depth:
                head, start = text[start:i], i + 1
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                yield head.strip(), text[start:i]
                start = i + 1
        i += 1
    if depth:
        yield head.strip(), text[start:]


def _bare(text: str, comments: str) -> str:
    """The text without its comments; quoted text is kept."""
    return re.sub(rf'("(?:\\.|[^"\\\n])*")|{comments}', lambda m: m.group(1) or " ", text)


_FIELD = re.compile(r"(?:(repeated|optional|required)\s+)?(map\s*<\s*[\w.]+\s*,\s*([\w.]+)\s*>|[\w.]+)\s+(\w+)\s*=\s*(\d+)")
_RPC = re.compile(r"rpc\s+(\w+)\s*\(\s*(stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(stream\s+)?([\w.]+)\s*\)")


def _proto(text: str, outer: str = "") -> Iterator[tuple]:
    for head, body in blocks(text, "\"'"):
        named = re.search(r"\b(message|enum|service|oneof)\s+(\w+)$", head)
        if not named:
            continue
        kind, name = named.groups()
        full = f"{outer}{name}"
        if kind != "oneof":
            yield kind, full, None, None, None
        if kind == "service":
            for rpc, _, into, _, back in _RPC.findall(body):
                yield "rpc", full, rpc, into, back
        elif kind == "enum":
            for value, number in re.findall(r"(\w+)\s*=\s*(-?\d+)", body):
                yield "value", full, value, None, number
        else:
            owner = outer[:-1] if kind == "oneof" else full
            for head_, inner in blocks(body, "\"'"):
                body = body.replace(f"{{{inner}}}", ";", 1)
                yield from _proto(f"{head_.rpartition(';')[2]} {{{inner}}}", f"{owner}.")
            for _, type_, value, field, _ in _FIELD.findall(body):
                type_ = value or type_
                yield "field", owner, field, None if type_ in PROTO_SCALARS else type_, type_


def proto_schema(files: DataFrame) -> DataFrame:
    """(path, kind, owner, name, refers, type): messages, enums and their values, fields, services, rpcs.

    ``refers`` is the message or enum that a field holds, or an rpc's request; ``type`` is the
    field's type, an rpc's response or a value's number. Nested names are joined by dots,
    fields of a oneof belong to the message around it.
    """
    comments = r"//[^\n]*|/\*.*?\*/"
    return _each(files, lambda t: _proto(re.sub(r"(?s)" + comments, " ", t)), "kind string, owner string, name string, refers string, type string")


def _graphql(text: str) -> Iterator[tuple]:
    text = re.sub(r'(?s)""".*?"""|"(?:\\.|[^"\\\n])*"|#[^\n]*', " ", text)
    for name in re.findall(r"\bscalar\s+(\w+)", text):
        yield "scalar", name, None, None, None
    for name, members in re.findall(r"\bunion\s+(\w+)[^={}]*=\s*\|?\s*(\w+(?:\s*\|\s*\w+)*)", text):
        yield "union", name, None, None, None
        for member in re.split(r"\s*\|\s*", members):
            yield "member", name, member, member, member
    for head, body in blocks(text):
        named = re.search(r"\b(type|interface|input|enum)\s+(\w+)([^{}]*)$", head)
        if not named:
            continue
        kind, name, more = named.groups()
        yield kind, name, None, None, None
        parents = re.search(r"\bimplements\b([\w\s&,]*)", more)
        for parent in re.findall(r"\w+", parents.group(1)) if parents else ():
            yield "implements", name, parent, parent, parent
        if kind == "enum":
            for value in re.findall(r"\w+", re.sub(r"@\w+(\([^)]*\))?", " ", body)):
                yield "value", name, value, None, None
            continue
        for field, args, type_ in re.findall(r"(\w+)\s*(\([^)]*\))?\s*:\s*([\[\]!\w]+)", body):
            base = re.sub(r"\W", "", type_)
            yield "field", name, field, None if base in GRAPHQL_SCALARS else base, type_
            for arg, kind_ in re.findall(r"(\w+)\s*:\s*([\[\]!\w]+)", args):
                base = re.sub(r"\W", "", kind_)
                yield "argument", f"{name}.{field}", arg, None if base in GRAPHQL_SCALARS else base, kind_


def graphql_schema(files: DataFrame) -> DataFrame:
    """(path, kind, owner, name, refers, type): types, interfaces, inputs, enums, unions, scalars with fields and arguments.

    ``refers`` is the named type without lists and bangs, null for built-in scalars.
    """
    return _each(files, _graphql, "kind string, owner string, name string, refers string, type string")


def schema_edges(schema: DataFrame) -> DataFrame:
    """(path, src, dst): a type refers to another one; arguments count for the type of their field."""
    return schema.filter("refers IS NOT NULL").select("path", F.when(F.col("kind") == "argument", F.split_part("owner", F.lit("."), F.lit(1))).otherwise(F.col("owner")).alias("src"), F.col("refers").alias("dst")).distinct()


def _listed(value) -> list[str]:
    """Entries of a Compose value that may be a list, a mapping or one text."""
    if isinstance(value, dict):
        return [str(k) for k in value]
    if isinstance(value, list):
        return [f"{v.get('published', '')}:{v.get('target', '')}".strip(":") if isinstance(v, dict) else str(v) for v in value]
    return [] if value is None else [str(value)]


def _compose(text: str) -> Iterator[tuple]:
    import yaml

    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError:
        return
    services = found.get("services") if isinstance(found, dict) else None
    for name, s in (services if isinstance(services, dict) else {}).items():
        s = s if isinstance(s, dict) else {}
        image = s.get("image")
        yield str(name), None if image is None else str(image), _listed(s.get("ports")), _listed(s.get("depends_on"))


def docker_map(files: DataFrame) -> DataFrame:
    """(path, service, image, ports, depends_on) of Compose files; needs PyYAML. Texts that are no YAML give no rows."""
    return _each(files, _compose, "service string, image string, ports array<string>, depends_on array<string>")


def start_order(services: DataFrame) -> DataFrame:
    """(path, service, level): services start after those they depend on; services on or behind a cycle have no row."""
    name = lambda service: F.concat_ws("\u0000", "path", service)
    nodes = services.select(name("service").alias("id"), F.lit("docker").alias("kind"), F.lit(1).cast("long").alias("lines")).distinct()
    edges = services.select("path", "service", F.explode("depends_on").alias("on")).select(name("on").alias("src"), name("service").alias("dst"))
    parts = F.split("id", "\u0000")
    return topo_sort(Graph(nodes, edges)).select(parts[0].alias("path"), parts[1].alias("service"), "level")


_REFERENCE = re.compile(r"\b(?:(data)\.(\w+)\.(\w+)|(var|local|module)\.(\w+)|([a-z]\w*_\w+)\.([A-Za-z_]\w*))")


def _terraform(text: str) -> Iterator[tuple]:
    for head, body in blocks(_bare(text, r"#[^\n]*|//[^\n]*|(?s:/\*.*?\*/)")):
        words = re.findall(r'"([^"]*)"|([\w-]+)', head.rpartition("\n")[2])
        words = [a or b for a, b in words]
        if not words or words[0] not in TERRAFORM_LABELS or len(words) != 1 + TERRAFORM_LABELS[words[0]]:
            continue
        kind, labels = words[0], words[1:]
        prefix = {"resource": [], "variable": ["var"], "locals": ["local"]}.get(kind, [kind])
        found = set()
        for d, dt, dn, scope, sn, rt, rn in _REFERENCE.findall(body):
            found.add(f"data.{dt}.{dn}" if d else f"{scope}.{sn}" if scope else f"{rt}.{rn}")
        address = ".".join(prefix + labels)
        yield kind, address, sorted(found - {address})


def terraform_map(files: DataFrame) -> DataFrame:
    """(path, kind, address, refers): top blocks of HCL texts and the addresses that their bodies name."""
    return _each(files, _terraform, "kind string, address string, refers array<string>")


def terraform_edges(found: DataFrame) -> DataFrame:
    """(src, dst) between blocks; ``local.x`` leads to the block ``local`` that holds it, unknown addresses are left out."""
    named = found.select("address", F.explode("refers").alias("to")).select(F.col("address").alias("src"), F.when(F.col("to").startswith("local."), "local").otherwise(F.col("to")).alias("dst"))
    return named.join(found.select(F.col("address").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").filter("src <> dst").distinct()


def reaches(edges: DataFrame, start: str) -> DataFrame:
    """(id, depth): what a block or type leads to."""
    return loops.bfs(edges, edges.sparkSession.createDataFrame([(start,)], "id string"))
