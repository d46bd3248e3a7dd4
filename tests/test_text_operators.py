"""Scans, web, security and byte-format operators on literal rows."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from graphloom.operators import scans, security, web
from graphloom.sources import binary


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def texts(spark, **named):
    return spark.createDataFrame([(k.replace("__", "/").replace("_", "."), v) for k, v in named.items()], "path string, content string")


def test_dependencies(spark):
    files = spark.createDataFrame(
        [
            ("a/requirements.txt", "# x\nnumpy==1.2\nPy-Yaml\n-r other.txt\n"),
            ("a/package.json", json.dumps({"dependencies": {"react": "^18"}, "devDependencies": {"jest": "1"}})),
            ("b/Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = "1.0"\nrand = { version = "0.8" }\n'),
            ("c/go.mod", "module m\nrequire github.com/a/b v1.0.0\n"),
            ("d/pom.xml", "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>2</version></dependency>"),
            ("e/Gemfile", "gem 'rails', '7'\n"),
            ("f/empty.txt", None),
        ],
        "path string, content string",
    )
    found = security.dep_tree(files)
    assert {(r["ecosystem"], r["name"], r["version"]) for r in found.collect()} == {
        ("pypi", "numpy", "1.2"), ("pypi", "Py-Yaml", ""), ("npm", "react", "^18"), ("npm", "jest", "1"), ("cargo", "serde", "1.0"),
        ("cargo", "rand", "0.8"), ("go", "github.com/a/b", "v1.0.0"), ("maven", "g:a", "2"), ("gem", "rails", "7"),
    }
    used = spark.createDataFrame([("numpy.linalg",), ("react/jsx",), ("serde::de",), ("py_yaml",), ("github.com/a/b/c",)], "module string")
    assert {r["name"] for r in security.dead_deps(found, used).collect()} == {"jest", "rand", "g:a", "rails"}


def test_routes(spark):
    files = texts(spark, app_py='@app.route("/u")\ndef u(): pass\n@app.post("/o")\n@cli.command("run")\n    def resolve_user(self): pass', s_js="app.get('/x', f)")
    assert rows(security.api_surface(files)) == sorted(
        [("app.py", "route", "GET", "/u"), ("app.py", "route", "POST", "/o"), ("app.py", "cli", "", "run"), ("app.py", "resolver", "", "user"), ("s.js", "route", "GET", "/x")], key=str
    )


def test_vulnerabilities(spark):
    old = {"CVE_Items": [{"cve": {"CVE_data_meta": {"ID": "CVE-2020-1"}}, "impact": {"baseMetricV3": {"cvssV3": {"baseScore": 9.8, "baseSeverity": "CRITICAL"}}}, "configurations": {"nodes": [{"cpe_match": [{"cpe23Uri": "cpe:2.3:a:v:openssl:1"}]}]}}]}
    new = {"vulnerabilities": [{"cve": {"id": "CVE-2021-2", "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 5.0, "baseSeverity": "MEDIUM"}}]}, "configurations": [{"nodes": [{"cpeMatch": [{"criteria": "cpe:2.3:a:v:zlib:1"}]}]}]}}]}
    cves = security.cve_import(texts(spark, a=json.dumps(old), b=json.dumps(new)))
    assert rows(cves.select("id", "cvss", "severity", "year", F.array_join("products", ","))) == [("CVE-2020-1", 9.8, "CRITICAL", "2020", "openssl"), ("CVE-2021-2", 5.0, "MEDIUM", "2021", "zlib")]
    dlls = spark.createDataFrame([("dll:libopenssl-1.1.dll",), ("dll:user32.dll",)], "id string")
    assert rows(security.cve_match(dlls, cves)) == [("dll:libopenssl-1.1.dll", "CVE-2020-1", "CRITICAL")]


def test_bills_of_materials(spark):
    p = spark.createDataFrame([("b", "2", None), ("a", "1", "MIT")], "name string, version string, license string")
    spdx = json.loads(security.to_spdx(p, "x").first()["document"])
    assert [(q["name"], q["licenseConcluded"]) for q in spdx["packages"]] == [("a", "MIT"), ("b", "NOASSERTION")]
    assert [c["name"] for c in json.loads(security.to_cyclonedx(p).first()["document"])["components"]] == ["a", "b"]


def test_har(spark):
    request = lambda m, u, t, **k: {"time": t, "request": {"method": m, "url": u, "headers": [{"name": "Authorization", "value": "x"}], "queryString": [{"name": "page"}], **k}, "response": {"status": 200, "content": {"mimeType": "x"}}}
    har = {"log": {"entries": [request("get", "https://h.com/u/12", 1.0), request("GET", "https://h.com/u/7", 3.0), request("POST", "https://h.com/o", 1.0, postData={"text": '{"b": 1}'}), request("GET", "https://h.com/a.js", 1.0)]}}
    entries = web.har_entries(texts(spark, x=json.dumps(har)))
    found = {(r["method"], r["pattern"]): r for r in web.web_api(entries).collect()}
    assert set(found) == {("GET", "/u/{id}"), ("POST", "/o")}
    assert (found["GET", "/u/{id}"]["n"], found["GET", "/u/{id}"]["avg_ms"], found["GET", "/u/{id}"]["params"]) == (2, 2.0, "page")
    assert found["POST", "/o"]["fields"] == "b" and found["POST", "/o"]["auth"] == "authorization"
    assert {r["section"] for r in web.web_blueprint(entries).collect()} == {"base", "auth", "call", "static", "paging"}


def test_recon(spark):
    robots = web.robots(texts(spark, r="User-agent: *\nDisallow: /admin # no\nAllow: /x\nSitemap: https://h/s.xml"))
    assert rows(robots.select("agent", "directive", "value", "category", "leaky")) == [("*", "allow", "/x", "Generic", False), ("*", "disallow", "/admin", "Admin", True), ("*", "sitemap", "https://h/s.xml", "Generic", False)]
    crt = web.crt_parse(texts(spark, c=json.dumps([{"name_value": "*.A.com\nb.com", "not_before": "2", "issuer_name": "i"}, {"name_value": "a.com", "not_before": "1", "issuer_name": "j"}])))
    assert rows(crt) == [("a.com", "1", 2), ("b.com", "2", 1)]
    api = web.openapi(texts(spark, o=json.dumps({"paths": {"/u": {"get": {"operationId": "listU"}}}})))
    assert rows(api) == [("/u", "GET", "listU")]
    assert rows(web.js_api_extract(texts(spark, j="fetch('/a'); axios.post(\"/b\"); x = {url: '/c'}"))) == [("j", "axios", "/b"), ("j", "fetch", "/a"), ("j", "url", "/c")]
    assert rows(web.sql_joins(texts(spark, s="select * from a join b on a.x = b.y"))) == [("a.x", "b.y")]


def test_rules(spark):
    bins = spark.createDataFrame([("x", ["a", "b", "api:Sleep"]), ("y", ["c"])], "id string, features array<string>")
    rules = {"both": {"and": ["a", "b"]}, "none": {"not": "a"}, "two": {"n or more": [2, ["a", "b", "c"]]}, "part": {"substring": "Sleep"}}
    assert rows(scans.capa_scan(bins, rules)) == [("x", "both"), ("x", "part"), ("x", "two"), ("y", "none")]
    data = spark.createDataFrame([("k", bytes.fromhex("00637c777bf26b6fc53001672bfed7ab7600")), ("l", struct.pack("<I", 0x9E3779B9))], "id string, data binary")
    assert rows(scans.crypto_constants(data)) == [("k", "aes_sbox", "big"), ("l", "tea_delta", "little")]
    s = spark.createDataFrame([("x", "run CertUtil.exe now"), ("x", "certutil.exe")], "id string, s string")
    assert rows(scans.match_substrings(s, [(n, n) for n in scans.LOLBINS])) == [("x", "certutil.exe", 2)]


def test_safetensors_and_broken_files(spark):
    head = json.dumps({"w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, "__metadata__": {}}).encode()
    good = struct.pack("<Q", len(head)) + head + b"\0" * 24
    files = spark.createDataFrame([("m", good), ("cut", good[:12]), ("empty", b""), ("none", None)], "path string, content binary")
    assert rows(binary.parse(files, binary.safetensors, "name string, dtype string, shape string, bytes long")) == [("m", "w", "F32", "2x3", 24)]


@pytest.mark.parametrize("name", ["gguf", "pyc", "elf", "pe", "pe_carve", "wasm", "java_class", "macho", "archive", "dbf", "strings"])
def test_readers_take_any_bytes(name):
    reader = getattr(binary, name)
    for data in (b"", b"\0" * 64, bytes(range(256))):
        try:
            list(reader(data))
        except (struct.error, ValueError, IndexError, KeyError, binary.zipfile.BadZipFile):
            pass
