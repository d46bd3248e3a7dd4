"""Strings, entropy and rule matching over features of files and binaries."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

STRING_CLASSES = [
    ("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"),
    ("user_agent", r"^(Mozilla|curl|Wget|python-requests)/"),
    ("email", r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"),
    ("guid", r"^\{?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\}?$"),
    ("registry", r"^(HKEY_|HKLM|HKCU|SOFTWARE\\|SYSTEM\\)"),
    ("path", r"^([A-Za-z]:\\|\\\\|/[A-Za-z0-9_.\-]+/)"),
    ("env", r"^(%[A-Za-z_]+%|\$[A-Z_]{2,}|\$\{[A-Za-z_]+\})"),
    ("sql", r"(?i)^(select .* from |insert into |update .* set |delete from |create table )"),
    ("format", r"%[0-9.\-]*[sdxfu]"),
    ("error", r"(?i)(error|fail|exception|invalid|cannot)"),
    ("hex", r"^(0x)?[0-9a-fA-F]{8,}$"),
    ("base64", r"^[A-Za-z0-9+/]{16,}={0,2}$"),
]


def string_class(s: Column) -> Column:
    """The first class whose pattern fits; strings under four characters are generic."""
    out = F.when(F.length(s) < 4, "generic")
    for name, pattern in STRING_CLASSES:
        out = out.when(s.rlike(pattern), name)
    return out.otherwise("generic")


def classify(strings: DataFrame) -> DataFrame:
    """(class, n) of strings (s)."""
    return strings.groupBy(string_class(F.col("s")).alias("class")).agg(F.count("*").alias("n"))


def entropy(rows: DataFrame) -> DataFrame:
    """(id, entropy, packed): Shannon entropy of the bytes of ``data``, by UTF-8 for text; packed from 7.0.

    Bytes are counted within the row, so nothing is shuffled. Null and empty data have 0.
    """
    types = T.StructType([rows.schema["id"], T.StructField("e", T.DoubleType())])
    found = rows.select("id", F.col("data").cast("binary").alias("data")).mapInArrow(_entropies, types)
    return found.select("id", F.round("e", 6).alias("entropy"), (F.col("e") >= 7.0).alias("packed"))


def _entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.zeros(batch.num_rows)
        for k, data in enumerate(batch.column(1)):
            size = data.as_buffer().size if data.is_valid else 0
            if size:
                c = np.bincount(np.frombuffer(data.as_buffer(), dtype=np.uint8))
                c = c[c > 0]
                found[k] = np.log2(size) - (c * np.log2(c)).sum() / size
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "e"])


def byte_entropy(rows: DataFrame) -> DataFrame:
    """The same over (id, byte, n) counts, for counts that are already tabular."""
    total = rows.groupBy("id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"))
    return total.select("id", F.round(F.log2(F.col("t").cast("double")) - F.col("s") / F.col("t"), 6).alias("entropy"))


def runs(pointers: DataFrame, least: int = 2) -> DataFrame:
    """(file, first, n, high): runs of consecutive slots that point at function entries; high from 4.

    ``pointers`` has (file, slot, is_entry).
    """
    w = Window.partitionBy("file").orderBy("slot")
    hit = pointers.filter("is_entry").withColumn("island", F.col("slot") - F.row_number().over(w))
    out = hit.groupBy("file", "island").agg(F.min("slot").alias("first"), F.count("*").alias("n"))
    return out.filter(F.col("n") >= least).select("file", "first", "n", (F.col("n") >= 4).alias("high"))


def disalign(instructions: DataFrame) -> DataFrame:
    """(file, at): bytes that one instruction starts at and another one covers. Rows (file, start, size)."""
    a = instructions.select("file", F.col("start").alias("at")).distinct()
    inner = instructions.filter("size > 1").select("file", F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("size") - 1)).alias("at")).distinct()
    return a.join(inner, ["file", "at"], "left_semi")


def crypto_loops(functions: DataFrame) -> DataFrame:
    """(id, confidence) of functions (id, xor_in_loop): 3 high, 2 medium, 1 low."""
    x = F.col("xor_in_loop")
    return functions.filter(x > 0).select("id", F.when(x >= 3, "high").when(x == 2, "medium").otherwise("low").alias("confidence"))


def switch_recovery(jumps: DataFrame, entries: DataFrame) -> DataFrame:
    """(fn, n, confidence): jump tables (fn, target); high where all targets are function entries (target)."""
    j = jumps.join(entries.select("target", F.lit(1).alias("hit")), "target", "left")
    per = j.groupBy("fn").agg(F.countDistinct("target").alias("n"), F.count("*").alias("all"), F.count("hit").alias("hits"))
    return per.filter("n >= 2").select("fn", "n", F.when(F.col("all") == F.col("hits"), "high").otherwise("medium").alias("confidence"))


def cff_detect(functions: DataFrame) -> DataFrame:
    """(id, confidence) of functions (id, score, back_edges, targets): flattened control flow."""
    s, b, t = F.col("score"), F.col("back_edges"), F.col("targets")
    grade = F.when((s >= 0.8) & (b >= 5) & (t >= 8), "high").when((s >= 0.6) & (b >= 3) & (t >= 4), "medium").when((s >= 0.6) & (b >= 5) & (t == 0), "low")
    return functions.select("id", grade.alias("confidence")).filter("confidence IS NOT NULL")


def opaque_predicates(instructions: DataFrame) -> DataFrame:
    """(fn, n, confidence): comparisons of a register with itself before a jump, within three instructions.

    Rows (fn, pos, op, same): ``op`` is cmp, test, xor, sub, jcc or other.
    """
    w = Window.partitionBy("fn").orderBy("pos")
    jump = F.greatest(*(F.coalesce((F.lead("op", i).over(w) == "jcc").cast("int"), F.lit(0)) for i in (1, 2, 3)))
    hit = instructions.withColumn("jump", jump).filter(F.col("same") & F.col("op").isin("cmp", "test", "xor", "sub") & (F.col("jump") == 1))
    n = F.col("n")
    return hit.groupBy("fn").agg(F.count("*").alias("n")).select("fn", "n", F.when(n >= 5, "high").when(n >= 2, "medium").otherwise("low").alias("confidence"))


def decoder_find(features: DataFrame, least: float = 0.3) -> DataFrame:
    """(fn, score, confidence): weighted mean of features (fn, weight, value)."""
    per = features.groupBy("fn").agg(F.round(F.sum(F.col("weight") * F.col("value")) / F.sum("weight"), 6).alias("score")).filter(F.col("score") >= least)
    return per.withColumn("confidence", F.when(F.col("score") >= 0.6, "high").when(F.col("score") >= 0.4, "medium").otherwise("low"))


def match_names(features: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, rule, category): features (id, feature) that equal a rule's (name, rule, category)."""
    return features.join(F.broadcast(rules), F.lower("feature") == F.lower("name")).select("id", "rule", "category").distinct()


def match_substrings(strings: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(id, rule, n): strings (id, s) that contain a rule's needle, any letter case; rules (needle, rule)."""
    s = F.lower("s")
    hits = F.array_compact(F.array(*(F.when(F.contains(s, F.lit(n.lower())), F.lit(r)) for n, r in rules)))
    return strings.select("id", F.explode(hits).alias("rule")).groupBy("id", "rule").agg(F.count("*").alias("n"))


ANTI_ANALYSIS = [
    ("IsDebuggerPresent", "debugger check", "anti_debug"), ("CheckRemoteDebuggerPresent", "remote debugger check", "anti_debug"), ("NtQueryInformationProcess", "process query", "anti_debug"),
    ("ptrace", "ptrace self", "anti_debug"), ("OutputDebugStringA", "debug output", "anti_debug"), ("GetTickCount", "timing", "timing"), ("QueryPerformanceCounter", "timing", "timing"),
    ("Sleep", "delay", "timing"), ("CreateToolhelp32Snapshot", "process list", "discovery"), ("VirtualProtect", "memory protection", "unpacking"), ("WriteProcessMemory", "injection", "injection"),
    ("CreateRemoteThread", "injection", "injection"), ("SetWindowsHookExA", "hook", "hooking"),
]
LOLBINS = "certutil.exe mshta.exe regsvr32.exe rundll32.exe bitsadmin.exe wmic.exe powershell.exe cmd.exe cscript.exe wscript.exe msbuild.exe installutil.exe schtasks.exe at.exe".split()
CRYPTO = {
    "aes_sbox": "637c777bf26b6fc53001672bfed7ab76", "aes_inverse_sbox": "52096ad53036a538bf40a39e81f3d7fb", "sha256_k": "428a2f98", "md5_k": "d76aa478",
    "crc32_table": "77073096", "chacha": "657870616e642033322d62797465206b", "tea_delta": "9e3779b9", "blowfish_p": "243f6a88",
}


def crypto_constants(rows: DataFrame) -> DataFrame:
    """(id, name, order): known constants in the bytes of ``data``, as they are or with words turned."""

    def turned(h: str) -> str:
        return "".join("".join(reversed([w[i : i + 2] for i in range(0, 8, 2)])) for w in (h[k : k + 8] for k in range(0, len(h), 8)))

    h = F.lower(F.hex("data"))
    hits = []
    for name, needle in CRYPTO.items():
        for order, text in (("big", needle), ("little", turned(needle))):
            at = F.instr(h, text)
            hits.append(F.when((at > 0) & (at % 2 == 1), F.struct(F.lit(name).alias("name"), F.lit(order).alias("order"))))
    return rows.select("id", F.inline(F.array_compact(F.array(*hits))))


def compile_rule(rule: Any, features: str = "features") -> Column:
    """A boolean expression from a capability rule tree over an array column of feature strings.

    A rule is a string (the feature), or one of {"and": [...]}, {"or": [...]}, {"not": rule},
    {"optional": [...]}, {"n or more": [n, [...]]}, {"substring": text}.
    """
    if isinstance(rule, str):
        return F.array_contains(features, rule)
    (key, arg), *_ = rule.items()
    parts = lambda xs: [compile_rule(x, features) for x in xs]
    if key == "and":
        out = F.lit(True)
        for p in parts(arg):
            out = out & p
        return out
    if key == "or":
        out = F.lit(False)
        for p in parts(arg):
            out = out | p
        return out
    if key == "not":
        return ~compile_rule(arg, features)
    if key == "optional":
        return F.lit(True)
    if key == "n or more":
        n, rules = arg
        return sum((p.cast("int") for p in parts(rules)), F.lit(0)) >= n
    if key == "substring":
        return F.exists(features, lambda f: F.contains(f, F.lit(arg)))
    raise ValueError(f"unknown rule node: {key}")


def capa_scan(binaries: DataFrame, rules: dict[str, Any]) -> DataFrame:
    """(id, rule): rules that the features of a binary (id, features) satisfy."""
    hits = F.array_compact(F.array(*(F.when(compile_rule(r), F.lit(n)) for n, r in rules.items())))
    return binaries.select("id", F.explode(hits).alias("rule"))


def apk_fingerprint(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, family): archive entries (id, entry) against rules (pattern, family), whole path or base name."""
    e = entries.select("id", F.explode(F.array(F.col("entry"), F.regexp_extract("entry", r"([^/]*)$", 1))).alias("pattern")).distinct()
    return e.join(F.broadcast(rules), "pattern").select("id", "family").distinct()


def com_scan(strings: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, guid, name): GUIDs in strings (id, s) that a catalog (guid, name) has."""
    g = F.regexp_extract_all("s", F.lit(r"\{?([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})\}?"), F.lit(1))
    return strings.select("id", F.explode(g).alias("guid")).select("id", F.upper("guid").alias("guid")).distinct().join(catalog.select(F.upper("guid").alias("guid"), "name"), "guid").select("id", "guid", "name")
