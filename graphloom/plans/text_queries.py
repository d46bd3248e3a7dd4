"""Queries over documents, pages and event properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import functions, scans, security, web
from graphloom.plans import tables as T
from graphloom.plans.catalog import query
from graphloom.plans.tables import FILES

_EMAIL = ("email", "low", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}")
_PHONE = ("phone", "low", r"\+?[0-9][0-9 ()\-]{8,}[0-9]")


def _scan_sql(rules: list[tuple[str, str, str]]) -> str:
    skip = security.SKIPPED_FILES
    base = f"WITH {FILES}, k AS (SELECT * FROM ln WHERE NOT regexp_matches(path, '{skip}') AND NOT regexp_matches(text, '^\\s*(//|#).*example')) "
    one = lambda n, s, p: f"SELECT path, line, '{n}' AS rule, '{s}' AS severity, substr(regexp_extract(text, '{p.replace(chr(39), chr(39) * 2)}'), 1, 4) || '***' AS preview FROM k WHERE regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')"
    return base + " UNION ALL ".join(one(*r) for r in rules)


@query(_scan_sql([*security.SECRET_RULES, _EMAIL, _PHONE]))
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return security.secret_scan(T.files(spark, d), [*security.SECRET_RULES, _EMAIL, _PHONE])


@query(f"WITH {FILES} SELECT path, CAST(line AS BIGINT) AS line, substr(text, 1, 100) AS text FROM ln WHERE regexp_matches(text, '\\bLicense\\b') AND NOT contains(text, 'export ') AND NOT contains(text, 'function License') ORDER BY path, line LIMIT 5000")
def callers(spark: SparkSession, d: str) -> DataFrame:
    return functions.callers(T.files(spark, d), "License")


@query(f"WITH {FILES} SELECT path, CAST(line AS BIGINT) AS line, text AS \"before\", regexp_replace(text, '\\bLicense\\b', 'Licence', 'g') AS \"after\" FROM ln WHERE regexp_matches(text, '\\bLicense\\b')")
def rename(spark: SparkSession, d: str) -> DataFrame:
    return functions.rename(T.files(spark, d), "License", "Licence")


def _license_sql() -> str:
    by = sorted(security.LICENSES, key=lambda x: -len(x[2]))
    phrase = "CASE " + " ".join(f"WHEN contains(content, '{p}') THEN '{s}'" for s, _, p in by) + " END"
    family = "CASE spdx " + " ".join(f"WHEN '{s}' THEN '{f}'" for s, f, _ in security.LICENSES) + " ELSE 'unknown' END"
    return f"WITH {FILES}, s AS (SELECT path, coalesce(nullif(regexp_extract(substr(content, 1, 16384), '{security.SPDX}', 1), ''), {phrase}) AS spdx FROM fl) SELECT path, spdx, {family} AS family FROM s WHERE spdx IS NOT NULL"


@query(_license_sql())
def license_scan(spark: SparkSession, d: str) -> DataFrame:
    return security.license_scan(T.files(spark, d))


_WORD_RE = {"branches": r"\b(if|for|while|do|switch|case|catch)\b", "logic": r"(\?\?|&&|\|\|)", "ternary": r"\?[^?.]"}


# Word limits are Unicode-aware here and in ASCII there, so accented letters are written as x.
@query("SELECT doc_id AS id, CAST(1 + " + " + ".join(f"len(regexp_extract_all(t, '{p}'))" for p in _WORD_RE.values()) + " AS BIGINT) AS complexity FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[À-ÖØ-öø-ÿŒœ]', 'x', 'g') AS t FROM documents)")
def complexity(spark: SparkSession, d: str) -> DataFrame:
    return functions.complexity(T.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).select("id", "complexity")


@query("""WITH b AS (SELECT doc_id AS id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents), c AS (SELECT id, byte, count(*) AS n FROM b GROUP BY 1, 2)
SELECT id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY id""")
def section_entropy(spark: SparkSession, d: str) -> DataFrame:
    rows = T.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "utf-8").alias("data"))
    return scans.entropy(rows).select("id", "entropy")


@query("SELECT CASE WHEN length(s) < 4 THEN 'generic' " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{n}'" for n, p in scans.STRING_CLASSES) + " ELSE 'generic' END AS class, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS s FROM documents) GROUP BY 1")
def string_classes(spark: SparkSession, d: str) -> DataFrame:
    return scans.classify(T.read(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("s")))


_PATH = "CASE WHEN regexp_replace(regexp_replace({0}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*', ''), '[?#].*$', '') = '' THEN '/' ELSE regexp_replace(regexp_replace({0}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*', ''), '[?#].*$', '') END"
_HOST = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#:]*)', 1))"


@query(f"SELECT {_HOST.format('url')} AS host, regexp_replace(regexp_replace({_PATH.format('url')}, '/[0-9]+(/|$)', '/{{id}}\\1', 'g'), '/[0-9a-fA-F\\-]{{32,}}(/|$)', '/{{id}}\\1', 'g') AS pattern, count(*) AS n FROM pages GROUP BY 1, 2")
def web_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return web.endpoints(T.read(spark, d, "pages"))


@query("WITH t AS (SELECT url, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) SELECT tag, count(*) AS n, count(DISTINCT url) AS pages FROM t GROUP BY tag")
def web_dom(spark: SparkSession, d: str) -> DataFrame:
    return web.web_dom(T.read(spark, d, "pages"))


@query("SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY href")
def phone_home(spark: SparkSession, d: str) -> DataFrame:
    return web.links(T.read(spark, d, "pages")).groupBy("href").agg(F.count("*").alias("n"))


_SITE = f"""WITH p AS (SELECT DISTINCT {_HOST.format('url')} || {_PATH.format('url')} AS id FROM pages),
l AS (SELECT url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages),
e AS (SELECT DISTINCT {_HOST.format('url')} || {_PATH.format('url')} AS src, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN {_HOST.format('href')} || {_PATH.format('href')} ELSE {_HOST.format('url')} || {_PATH.format('href')} END AS dst FROM l),
k AS (SELECT * FROM e WHERE src <> dst AND dst IN (SELECT id FROM p))"""


@query(_SITE + " SELECT 'entry' AS role, count(*) AS n FROM p WHERE id NOT IN (SELECT dst FROM k) UNION ALL SELECT 'dead_end', count(*) FROM p WHERE id NOT IN (SELECT src FROM k)")
def web_sitemap(spark: SparkSession, d: str) -> DataFrame:
    return web.site_roles(T.read(spark, d, "pages"))


@query(" UNION ALL ".join(f"SELECT url, '{n}' AS tech, '{c}' AS category FROM pages WHERE {' OR '.join(f'contains(html, {chr(39)}{p}{chr(39)})' for p in ps)}" for n, c, ps in web.TECH))
def web_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return web.web_fingerprint(T.read(spark, d, "pages"))


@query("SELECT event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2")
def event_attributes(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return T.read(spark, d, "events").groupBy(F.col("event_type").alias("kind"), (k % 10).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query(f"WITH {FILES}, t AS (SELECT path, lower(unnest(regexp_extract_all(content, '(?i)\\b(?:from|join|into|update)\\s+([A-Za-z_][A-Za-z0-9_.]*)', 1))) AS \"table\" FROM fl) SELECT path, \"table\", count(*) AS n FROM t GROUP BY 1, 2")
def sql_extract(spark: SparkSession, d: str) -> DataFrame:
    return web.sql_extract(T.files(spark, d))


@query("SELECT doc_id AS id, r AS rule, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) x JOIN (VALUES ('license', 'license'), ('copyright', 'copyright'), ('http', 'link')) v(k, r) ON contains(lower(s), k) GROUP BY 1, 2")
def lolbin_scan(spark: SparkSession, d: str) -> DataFrame:
    lines = T.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("s"))
    return scans.match_substrings(lines, [("license", "license"), ("copyright", "copyright"), ("http", "link")])
