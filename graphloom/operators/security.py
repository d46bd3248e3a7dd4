"""Secrets, manifests, licences, vulnerabilities and bills of materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.functions import lines_of

#: name, severity, pattern; own patterns for the ten classes of secret that the survey lists.
SECRET_RULES = [
    ("aws_key", "critical", r"\bAKIA[0-9A-Z]{16}\b"),
    ("aws_secret", "critical", r"(?i)aws.{0,20}secret.{0,20}['\"][0-9a-zA-Z/+]{40}['\"]"),
    ("private_key", "critical", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("github_pat", "high", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    ("api_key", "high", r"(?i)api_?key['\"]?\s*[:=]\s*['\"][A-Za-z0-9_\-]{16,}['\"]"),
    ("password", "high", r"(?i)passw(or)?d['\"]?\s*[:=]\s*['\"][^'\"]{6,}['\"]"),
    ("token", "high", r"(?i)(secret|token)['\"]?\s*[:=]\s*['\"][A-Za-z0-9_\-]{12,}['\"]"),
    ("jwt", "high", r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{5,}"),
    ("connection", "medium", r"(?i)(postgres|mysql|mongodb|redis|amqp)://[^\s:@/]+:[^\s@]+@"),
    ("ip_port", "medium", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}:[0-9]{2,5}\b"),
]
SKIPPED_FILES = r"(package-lock\.json|yarn\.lock|Cargo\.lock|\.min\.|(^|/)fixtures/)"


def mask(found: Column) -> Column:
    return F.concat(F.substring(found, 1, 4), F.lit("***"))


def secret_scan(files: DataFrame, rules: list[tuple[str, str, str]] = SECRET_RULES) -> DataFrame:
    """(path, line, rule, severity, preview): the first match of each rule in each line.

    One pass: every rule is an expression over the line, so texts are neither joined nor copied.
    """
    rows = lines_of(files.filter(~F.col("path").rlike(SKIPPED_FILES)))
    rows = rows.filter(~F.col("text").rlike(r"^\s*(//|#).*example"))
    hits = [F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.regexp_extract("text", p, 0).alias("found")) for n, s, p in rules]
    found = rows.select("path", "line", F.inline(F.filter(F.array(*hits), lambda h: h["found"] != "")))
    return found.select("path", "line", "rule", "severity", mask(F.col("found")).alias("preview"))


def secret_nodes(found: DataFrame) -> DataFrame:
    """Graph nodes (id, kind, attrs) of found secrets."""
    return found.select(
        F.concat_ws("::", F.concat(F.lit("secret:"), F.col("path")), F.col("line").cast("string"), "rule").alias("id"),
        F.lit("secret").alias("kind"),
        F.create_map(F.lit("severity"), F.col("severity"), F.lit("preview"), F.col("preview")).alias("attrs"),
    )


def dep_tree(files: DataFrame) -> DataFrame:
    """(path, ecosystem, name, version, id) declared in manifests, by file name."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    f = files.select("path", "content", base.alias("base"))

    def lines(only: Column, pattern: str, eco: str, skip: str = r"^\s*(#|$)") -> DataFrame:
        rows = lines_of(f.filter(only)).filter(~F.col("text").rlike(skip))
        name, version = F.regexp_extract("text", pattern, 1), F.regexp_extract("text", pattern, 2)
        return rows.select("path", F.lit(eco).alias("ecosystem"), name.alias("name"), version.alias("version")).filter("name <> ''")

    b = F.col("base")
    pip = lines(b.rlike(r"^requirements.*\.txt$"), r"^\s*([A-Za-z0-9_.\-]+)\s*(?:\[[^\]]*\])?\s*(?:[=~<>!]=?\s*([^\s;,#]+))?", "pypi", r"^\s*(#|-|$)")
    go = lines(b == "go.mod", r"^\s*(?:require\s+)?([a-z0-9.\-]+\.[a-z]+/\S+)\s+(v\S+)", "go", r"^\s*(//|module|$)")
    gem = lines(b == "Gemfile", r"^\s*gem\s+['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?", "gem")
    gradle = lines(b.rlike(r"^build\.gradle(\.kts)?$"), r"(?:implementation|api|compile)\s*\(?['\"]([^:'\"]+:[^:'\"]+):([^'\"]+)['\"]", "maven", r"^\s*(//|$)")
    npm = f.filter(b == "package.json").select("path", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>").alias("j"))
    npm = npm.select("path", F.explode(F.concat(F.coalesce(F.map_entries("j.dependencies"), F.array()), F.coalesce(F.map_entries("j.devDependencies"), F.array()))).alias("d"))
    npm = npm.select("path", F.lit("npm").alias("ecosystem"), F.col("d.key").alias("name"), F.col("d.value").alias("version"))
    toml = f.filter(b.isin("Cargo.toml", "pyproject.toml")).select("path", "base", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\[[^\]]*dependencies[^\]]*\]\n((?:[^\[\n].*\n?|\n)*)"), F.lit(1))).alias("content"))
    toml = toml.select("path", "base", F.explode(F.split("content", "\n")).alias("text"))
    pattern = r"^\s*([A-Za-z0-9_\-]+)\s*=\s*(?:\{.*version\s*=\s*)?\"([^\"]*)\""
    toml = toml.select("path", F.when(F.col("base") == "Cargo.toml", "cargo").otherwise("pypi").alias("ecosystem"), F.regexp_extract("text", pattern, 1).alias("name"), F.regexp_extract("text", pattern, 2).alias("version")).filter("name <> ''")
    pom = f.filter(b == "pom.xml").select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("d"))
    tag = lambda t: F.regexp_extract("d", rf"<{t}>([^<]*)</{t}>", 1)
    pom = pom.select("path", F.lit("maven").alias("ecosystem"), F.concat_ws(":", tag("groupId"), tag("artifactId")).alias("name"), tag("version").alias("version"))
    out = pip.union(go).union(gem).union(gradle).union(npm).union(toml).union(pom)
    return out.withColumn("id", F.concat_ws(":", F.lit("dep"), "ecosystem", "name"))


def dead_deps(declared: DataFrame, imported: DataFrame) -> DataFrame:
    """Declared dependencies (path, ecosystem, name, ...) that no import (module) is or starts with.

    Hyphens count as underscores; an import belongs to a name up to the first ``/``, ``::``
    or ``.``, or to a scoped or dotted name in full. Both sides meet on equal keys.
    """
    norm = lambda c: F.lower(F.regexp_replace(c, "-", "_"))
    m = norm(F.col("module"))
    keys = imported.select(F.explode(F.array(m, F.regexp_extract(m, r"^([^/.:]+)", 1), F.regexp_extract(m, r"^(@?[^/]+/[^/]+)", 1), F.regexp_extract(m, r"^([^/]+/[^/]+/[^/]+)", 1))).alias("key")).filter("key <> ''").distinct()
    return declared.withColumn("key", norm(F.col("name"))).join(keys, "key", "left_anti").drop("key")


def api_surface(files: DataFrame) -> DataFrame:
    """(path, kind, method, name): routes, command-line commands and resolvers, each once a file."""
    rows = lines_of(files)
    route = r"@\w+\.(route|get|post|put|delete|patch)\(\s*['\"]([^'\"]+)['\"]"
    express = r"\b(?:app|router)\.(get|post|put|delete|patch)\(\s*['\"`]([^'\"`]+)['\"`]"
    command = r"@\w+\.command\(\s*(?:['\"]([^'\"]+)['\"])?"
    pick = lambda kind, p, method, name: rows.filter(F.col("text").rlike(p)).select("path", F.lit(kind).alias("kind"), method.alias("method"), name.alias("name"))
    verb = F.upper(F.regexp_extract("text", route, 1))
    out = pick("route", route, F.when(verb == "ROUTE", "GET").otherwise(verb), F.regexp_extract("text", route, 2))
    out = out.union(pick("route", express, F.upper(F.regexp_extract("text", express, 1)), F.regexp_extract("text", express, 2)).join(pick("route", route, F.lit(""), F.lit("")).select("path").distinct(), "path", "left_anti"))
    out = out.union(pick("cli", command, F.lit(""), F.regexp_extract("text", command, 1)))
    out = out.union(pick("resolver", r"^\s*def resolve_\w+", F.lit(""), F.regexp_extract("text", r"def resolve_(\w+)", 1)))
    return out.distinct()


#: spdx id, family, phrase; phrases of the licences' own names.
LICENSES = [
    ("Apache-2.0", "permissive", "Apache License, Version 2"), ("MIT", "permissive", "MIT License"), ("BSD-3-Clause", "permissive", "BSD 3-Clause"),
    ("ISC", "permissive", "ISC License"), ("MPL-2.0", "weak_copyleft", "Mozilla Public License"), ("LGPL-3.0", "weak_copyleft", "GNU Lesser General Public License"),
    ("GPL-3.0", "strong_copyleft", "GNU General Public License, version 3"), ("AGPL-3.0", "strong_copyleft", "GNU Affero General Public License"),
    ("CC-BY-NC-4.0", "proprietary", "CC BY-NC 4"),
]
SPDX = r"SPDX-License-Identifier:\s*([A-Za-z0-9.+\-]+)"


def license_scan(files: DataFrame, head: int = 16384) -> DataFrame:
    """(path, spdx, family): an SPDX marker in the head of a file, else the longest licence phrase in it."""
    by_phrase = sorted(LICENSES, key=lambda x: -len(x[2]))
    spdx = F.nullif(F.regexp_extract(F.substring("content", 1, head), SPDX, 1), F.lit(""))
    phrase = F.coalesce(*(F.when(F.contains("content", F.lit(p)), F.lit(s)) for s, _, p in by_phrase))
    family = F.create_map(*(F.lit(x) for s, f, _ in LICENSES for x in (s, f)))
    out = files.select("path", F.coalesce(spdx, phrase).alias("spdx")).filter("spdx IS NOT NULL")
    return out.select("path", "spdx", F.coalesce(family[F.col("spdx")], F.lit("unknown")).alias("family"))


_NVD = """
CVE_Items array<struct<cve:struct<CVE_data_meta:struct<ID:string>,problemtype:struct<problemtype_data:array<struct<description:array<struct<value:string>>>>>>,
  impact:struct<baseMetricV3:struct<cvssV3:struct<baseScore:double,baseSeverity:string>>>,configurations:struct<nodes:array<struct<cpe_match:array<struct<cpe23Uri:string>>>>>>>,
vulnerabilities array<struct<cve:struct<id:string,metrics:struct<cvssMetricV31:array<struct<cvssData:struct<baseScore:double,baseSeverity:string>>>>,
  weaknesses:array<struct<description:array<struct<value:string>>>>,configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<criteria:string>>>>>>>>>
"""


def cve_import(texts: DataFrame) -> DataFrame:
    """(id, cvss, severity, year, cwe, products) from NVD JSON of either layout (column ``content``)."""
    j = texts.select(F.from_json("content", _NVD.replace("\n", " ")).alias("j"))
    one = j.select(F.explode("j.CVE_Items").alias("x")).select(
        F.col("x.cve.CVE_data_meta.ID").alias("id"),
        F.col("x.impact.baseMetricV3.cvssV3.baseScore").alias("cvss"),
        F.col("x.impact.baseMetricV3.cvssV3.baseSeverity").alias("severity"),
        F.col("x.cve.problemtype.problemtype_data")[0]["description"][0]["value"].alias("cwe"),
        F.flatten(F.transform("x.configurations.nodes", lambda n: F.transform(n["cpe_match"], lambda c: c["cpe23Uri"]))).alias("cpe"),
    )
    two = j.select(F.explode("j.vulnerabilities").alias("x")).select(
        F.col("x.cve.id").alias("id"),
        F.col("x.cve.metrics.cvssMetricV31")[0]["cvssData"]["baseScore"].alias("cvss"),
        F.col("x.cve.metrics.cvssMetricV31")[0]["cvssData"]["baseSeverity"].alias("severity"),
        F.col("x.cve.weaknesses")[0]["description"][0]["value"].alias("cwe"),
        F.flatten(F.flatten(F.transform("x.cve.configurations", lambda c: F.transform(c["nodes"], lambda n: F.transform(n["cpeMatch"], lambda m: m["criteria"]))))).alias("cpe"),
    )
    products = F.array_sort(F.array_distinct(F.transform(F.coalesce("cpe", F.array()), lambda c: F.split_part(c, F.lit(":"), F.lit(5)))))
    return one.union(two).select("id", "cvss", "severity", F.regexp_extract("id", r"CVE-(\d{4})", 1).alias("year"), "cwe", products.alias("products"))


def library_name(path: Column) -> Column:
    """Base name of a library without extension, version and ``lib`` prefix, lower case."""
    base = F.lower(F.regexp_extract(path, r"([^/\\:]*)$", 1))
    base = F.regexp_replace(base, r"\.(dll|so|dylib)([0-9.]*)$", "")
    return F.regexp_replace(F.regexp_replace(base, r"^lib", ""), r"[\-_]?[0-9][0-9._\-]*$", "")


def _grams(c: str) -> Column:
    """The distinct runs of three characters of a text of three or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(F.col(c), i, F.lit(3))))


def cve_match(dlls: DataFrame, cves: DataFrame) -> DataFrame:
    """(dll, cve, severity): a library's name contains a product or the reverse, both of three characters or more.

    What contains a text has its first three characters somewhere, so names and products
    meet on those and only such pairs are compared.
    """
    p = cves.select(F.col("id").alias("cve"), "severity", F.explode("products").alias("product")).filter("length(product) >= 3")
    d = dlls.select(F.col("id").alias("dll"), library_name(F.col("id")).alias("name")).filter("length(name) >= 3")
    start = lambda c: F.substring(c, 1, 3).alias("gram")
    holds = d.withColumn("gram", F.explode(_grams("name"))).join(p.select("*", start("product")), "gram").filter(F.col("name").contains(F.col("product")))
    held = p.withColumn("gram", F.explode(_grams("product"))).join(d.select("*", start("name")), "gram").filter(F.col("product").contains(F.col("name")))
    return holds.select("dll", "cve", "severity").union(held.select("dll", "cve", "severity")).distinct()


def to_spdx(packages: DataFrame, name: str) -> DataFrame:
    """One row (document): an SPDX 2.3 JSON of packages (name, version, license)."""
    p = F.struct(F.concat(F.lit("SPDXRef-"), F.regexp_replace("name", r"[^A-Za-z0-9.\-]", "-")).alias("SPDXID"), F.col("name"), F.col("version").alias("versionInfo"), F.coalesce("license", F.lit("NOASSERTION")).alias("licenseConcluded"))
    rows = packages.agg(F.array_sort(F.collect_list(p)).alias("packages"))
    return rows.select(F.to_json(F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.lit(name).alias("name"), "packages")).alias("document"))


def to_cyclonedx(packages: DataFrame) -> DataFrame:
    """One row (document): a CycloneDX 1.5 JSON of packages (name, version, license)."""
    lic = F.when(F.col("license").isNotNull(), F.array(F.struct(F.struct(F.col("license").alias("id")).alias("license"))))
    c = F.struct(F.lit("library").alias("type"), F.col("name"), F.col("version"), lic.alias("licenses"))
    rows = packages.agg(F.array_sort(F.collect_list(c)).alias("components"))
    return rows.select(F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"), "components")).alias("document"))


def rules_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
