"""Web pages, traffic logs and recon files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.functions import lines_of


def path_of(url: Column) -> Column:
    """The path of a URL, without query and fragment; ``/`` where there is none."""
    p = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.when(p == "", F.lit("/")).otherwise(p)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)", 1))


def pattern_of(path: Column) -> Column:
    """A path with numbers and long hexadecimal segments replaced by ``{id}``."""
    return F.regexp_replace(F.regexp_replace(path, r"/[0-9]+(/|$)", "/{id}$1"), r"/[0-9a-fA-F\-]{32,}(/|$)", "/{id}$1")


def endpoints(pages: DataFrame) -> DataFrame:
    """(host, pattern, n): URLs of pages (url) by host and normalised path."""
    return pages.select(host_of(F.col("url")).alias("host"), pattern_of(path_of(F.col("url"))).alias("pattern")).groupBy("host", "pattern").agg(F.count("*").alias("n"))


HREF = r"<a [^>]*href=\"([^\"]*)\""


def links(pages: DataFrame) -> DataFrame:
    """(url, href): every link of every page."""
    return pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href"))


def web_dom(pages: DataFrame) -> DataFrame:
    """(tag, n, pages): how often each element opens, and on how many pages."""
    tags = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy("url", "tag").agg(F.count("*").alias("k")).groupBy("tag").agg(F.sum("k").alias("n"), F.count("*").alias("pages"))


def web_forms(pages: DataFrame) -> DataFrame:
    """(url, action, method, fields) of forms."""
    f = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?s)(<form.*?</form>)"), F.lit(1))).alias("f"))
    fields = F.array_join(F.array_sort(F.regexp_extract_all("f", F.lit(r"<(?:input|select|textarea)[^>]*name=\"([^\"]*)\""), F.lit(1))), ",")
    method = F.upper(F.regexp_extract("f", r"<form[^>]*method=\"([^\"]*)\"", 1))
    return f.select("url", F.regexp_extract("f", r"<form[^>]*action=\"([^\"]*)\"", 1).alias("action"), F.when(method == "", "GET").otherwise(method).alias("method"), fields.alias("fields"))


def sitemap_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): links whose target is a page of the set, by host and path."""
    key = F.concat(host_of(F.col("url")), path_of(F.col("url")))
    known = pages.select(key.alias("dst")).distinct()
    found = links(pages)
    target = F.when(F.col("href").rlike("^[a-z]+://"), F.concat(host_of(F.col("href")), path_of(F.col("href")))).otherwise(F.concat(host_of(F.col("url")), path_of(F.col("href"))))
    return found.select(key.alias("src"), target.alias("dst")).distinct().join(known, "dst", "left_semi").filter("src <> dst").select("src", "dst")


def site_roles(pages: DataFrame) -> DataFrame:
    """(role, n): entry points (no link comes in) and dead ends (no link goes out) among pages."""
    e = sitemap_edges(pages)
    p = pages.select(F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("id")).distinct()
    entry = p.join(e.select(F.col("dst").alias("id")), "id", "left_anti").select(F.lit("entry").alias("role"))
    dead = p.join(e.select(F.col("src").alias("id")), "id", "left_anti").select(F.lit("dead_end").alias("role"))
    return entry.union(dead).groupBy("role").agg(F.count("*").alias("n"))


_HAR = """log struct<entries:array<struct<time:double,request:struct<method:string,url:string,headers:array<struct<name:string,value:string>>,
queryString:array<struct<name:string>>,postData:struct<mimeType:string,text:string>>,response:struct<status:int,content:struct<mimeType:string>>>>>"""
STATIC = r"\.(js|css|png|jpe?g|gif|svg|ico|woff2?|ttf|map)$"


def har_entries(texts: DataFrame) -> DataFrame:
    """Requests of HAR files (column ``content``)."""
    x = texts.select(F.explode(F.from_json("content", _HAR.replace("\n", " "))["log"]["entries"]).alias("e"))
    r = F.col("e.request")
    fields = F.coalesce(F.json_object_keys(r["postData"]["text"]), F.array())
    return x.select(
        F.upper(r["method"]).alias("method"),
        r["url"].alias("url"),
        path_of(r["url"]).alias("path"),
        F.coalesce(F.transform(r["queryString"], lambda q: q["name"]), F.array()).alias("params"),
        fields.alias("fields"),
        F.transform(F.filter(r["headers"], lambda h: F.lower(h["name"]).isin("authorization", "cookie", "x-api-key")), lambda h: F.lower(h["name"])).alias("auth"),
        F.col("e.response.status").alias("status"),
        F.col("e.response.content.mimeType").alias("mime"),
        F.col("e.time").alias("time"),
    )


def web_api(entries: DataFrame) -> DataFrame:
    """(method, pattern, n, params, fields, statuses, auth, avg_ms) of calls that are no static assets."""
    calls = entries.filter(~F.col("path").rlike(STATIC)).withColumn("pattern", pattern_of(F.col("path")))
    all_ = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))), ",")
    return calls.groupBy("method", "pattern").agg(
        F.count("*").alias("n"),
        all_("params").alias("params"),
        all_("fields").alias("fields"),
        F.array_join(F.array_sort(F.collect_set(F.col("status").cast("string"))), ",").alias("statuses"),
        all_("auth").alias("auth"),
        F.round(F.avg("time"), 3).alias("avg_ms"),
    )


def web_blueprint(entries: DataFrame) -> DataFrame:
    """(section, name, n): base hosts, authentication headers, calls, static assets and paging parameters."""
    rows = [
        entries.select(F.lit("base").alias("section"), host_of(F.col("url")).alias("name")),
        entries.select(F.lit("auth"), F.explode("auth")),
        entries.filter(~F.col("path").rlike(STATIC)).select(F.lit("call"), F.concat_ws(" ", "method", pattern_of(F.col("path")))),
        entries.filter(F.col("path").rlike(STATIC)).select(F.lit("static"), "path"),
        entries.select(F.lit("paging"), F.explode("params").alias("p")).filter(F.col("p").isin("page", "limit", "offset", "cursor", "per_page")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.groupBy("section", "name").agg(F.count("*").alias("n"))


JS_CALLS = [
    ("fetch", r"fetch\(\s*['\"`]([^'\"`]+)['\"`]"),
    ("axios", r"axios\.(?:get|post|put|delete|patch)\(\s*['\"`]([^'\"`]+)['\"`]"),
    ("xhr", r"\.open\(\s*['\"][A-Z]+['\"]\s*,\s*['\"`]([^'\"`]+)['\"`]"),
    ("url", r"\burl\s*:\s*['\"`]([^'\"`]+)['\"`]"),
    ("base", r"base[Uu][Rr][Ll]\s*[:=]\s*['\"`]([^'\"`]+)['\"`]"),
]


def js_api_extract(files: DataFrame) -> DataFrame:
    """(path, via, url) of calls in scripts."""

    def calls(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), lambda u: F.struct(F.lit(name).alias("via"), u.alias("url")))

    found = F.flatten(F.array(*(calls(n, p) for n, p in JS_CALLS)))
    return files.select("path", F.inline(found)).distinct()


def robots(files: DataFrame) -> DataFrame:
    """(path, agent, directive, value, category, leaky) of robots.txt lines."""
    rows = lines_of(files).select("path", "line", F.lower(F.trim(F.regexp_extract("text", r"^\s*([A-Za-z\-]+)\s*:", 1))).alias("directive"), F.trim(F.regexp_extract("text", r"^\s*[A-Za-z\-]+\s*:\s*([^#]*)", 1)).alias("value"))
    w = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("agent", F.last(F.when(F.col("directive") == "user-agent", F.col("value")), ignorenulls=True).over(w))
    v = F.lower("value")
    category = (
        F.when(v.rlike("admin|manage|console"), "Admin").when(v.rlike("backup|\\.git|\\.env|secret|private|config"), "Sensitive").when(v.rlike("/api|graphql|/v[0-9]+/"), "Api")
        .when(v.rlike("login|auth|account|signin"), "Auth").when(v.rlike("search|\\?q="), "Search").when(v.rlike("\\.(js|css|png|jpg|svg)|/static|/assets"), "Asset").otherwise("Generic")
    )
    out = rows.filter(F.col("directive").isin("allow", "disallow", "sitemap")).select("path", "agent", "directive", "value", category.alias("category"))
    return out.withColumn("leaky", (F.col("directive") == "disallow") & F.col("category").isin("Admin", "Sensitive", "Api"))


def sitemap_parse(files: DataFrame) -> DataFrame:
    """(pattern, n) of <loc> entries; segments with four digits or a UUID are ids."""
    loc = files.select(F.explode(F.regexp_extract_all("content", F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))).alias("url"))
    p = F.regexp_replace(F.regexp_replace(path_of(F.col("url")), r"/[^/]*[0-9]{4,}[^/]*", "/{ID}"), r"/[0-9a-fA-F]{8}-[0-9a-fA-F\-]{27}", "/{ID}")
    return loc.groupBy(p.alias("pattern")).agg(F.count("*").alias("n"))


TECH = [
    ("WordPress", "cms", ("wp-content", "wp-includes")), ("Drupal", "cms", ("Drupal.settings", "/sites/default/")), ("Joomla", "cms", ("/media/jui/",)),
    ("React", "framework", ("data-reactroot", "react-dom", "__REACT")), ("Vue", "framework", ("data-v-", "vue.js", "vue.min.js")), ("Angular", "framework", ("ng-version", "ng-app")),
    ("Next.js", "framework", ("__NEXT_DATA__",)), ("jQuery", "library", ("jquery",)), ("Bootstrap", "library", ("bootstrap.min",)),
    ("Google Analytics", "analytics", ("google-analytics.com", "gtag(")), ("Tracker", "analytics", ("track(",)), ("Cloudflare", "cdn", ("cdn-cgi", "cloudflare")),
    ("Shopify", "commerce", ("cdn.shopify",)), ("nginx", "server", ("nginx",)), ("HTML5", "markup", ("<!DOCTYPE html>", "<article")),
]


def web_fingerprint(pages: DataFrame, rules: list[tuple[str, str, tuple[str, ...]]] = TECH) -> DataFrame:
    """(url, tech, category): technologies any of whose marks a page has."""
    hits = [F.when(F.greatest(*(F.contains("html", F.lit(p)).cast("int") for p in ps), F.lit(0)) == 1, F.struct(F.lit(n).alias("tech"), F.lit(c).alias("category"))) for n, c, ps in rules]
    return pages.select("url", F.inline(F.array_compact(F.array(*hits))))


def crt_parse(texts: DataFrame) -> DataFrame:
    """(name, first_seen, issuers) of certificate transparency JSON (column ``content``)."""
    x = texts.select(F.explode(F.from_json("content", "array<struct<name_value:string,not_before:string,issuer_name:string>>")).alias("c"))
    rows = x.select(F.explode(F.split("c.name_value", "\n")).alias("name"), "c.not_before", "c.issuer_name")
    name = F.lower(F.regexp_replace("name", r"^\*\.", ""))
    return rows.groupBy(name.alias("name")).agg(F.min("not_before").alias("first_seen"), F.countDistinct("issuer_name").alias("issuers"))


def openapi(texts: DataFrame) -> DataFrame:
    """(path, method, operation) of OpenAPI JSON (column ``content``)."""
    paths = F.from_json("content", "paths map<string,map<string,struct<operationId:string>>>")["paths"]
    x = texts.select(F.explode(paths).alias("path", "ops")).select("path", F.explode("ops").alias("method", "op"))
    return x.filter(F.col("method").isin("get", "post", "put", "delete", "patch", "head", "options")).select("path", F.upper("method").alias("method"), F.col("op.operationId").alias("operation"))


def sql_extract(texts: DataFrame) -> DataFrame:
    """(path, table, n): tables after FROM, JOIN, INTO and UPDATE."""
    found = texts.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?i)\b(?:from|join|into|update)\s+([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1))).alias("table"))
    return found.groupBy("path", F.lower("table").alias("table")).agg(F.count("*").alias("n"))


def sql_joins(texts: DataFrame) -> DataFrame:
    """(a, b): column pairs compared in ON clauses."""
    on = r"(?i)\bon\s+([A-Za-z_][A-Za-z0-9_]*\.[A-Za-z0-9_]+\s*=\s*[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z0-9_]+)"
    x = texts.select(F.explode(F.regexp_extract_all("content", F.lit(on), F.lit(1))).alias("j"))
    return x.select(F.trim(F.split_part("j", F.lit("="), F.lit(1))).alias("a"), F.trim(F.split_part("j", F.lit("="), F.lit(2))).alias("b")).distinct()
