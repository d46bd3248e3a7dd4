"""Schema texts and composed reports."""

import pytest

from graphloom.operators import composite
from graphloom.sources import schemas


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, content string")


def test_proto_nests():
    text = """message A { // {
  optional string s = 1; /* int32 no = 9; */ map<string, B> m = 2;
  message In { repeated a.B b = 1; } oneof pick { In x = 3; int32 y = 4; }
  enum K { NO = 0; YES = -1; } K k = 5; }
service S { rpc Get (stream A) returns (a.B) { option x = "{"; } }
message Open { int32 z = 1;"""
    text = schemas.re.sub(r"(?s)//[^\n]*|/\*.*?\*/", " ", text)
    got = set(schemas._proto(text))
    assert {("message", "A", None, None, None), ("field", "A", "s", None, "string"), ("field", "A", "m", "B", "B"), ("field", "A.In", "b", "a.B", "a.B"), ("field", "A", "x", "In", "In"), ("field", "A", "y", None, "int32"), ("value", "A.K", "YES", None, "-1"), ("field", "A", "k", "K", "K"), ("rpc", "S", "Get", "A", "a.B"), ("field", "Open", "z", None, "int32")} <= got
    assert not any(r[2] == "no" for r in got)


def test_graphql_types():
    text = '"""type No { a: B }"""\nscalar Date\nunion U = | A | B\ntype A implements I & J @k(f: "x") { a(by: In!, n: Int): [B!]! # c: D\n d: Date }\nenum E { X Y @deprecated(reason: "z") }'
    got = set(schemas._graphql(text))
    assert {("scalar", "Date", None, None, None), ("member", "U", "B", "B", "B"), ("implements", "A", "J", "J", "J"), ("field", "A", "a", "B", "[B!]!"), ("argument", "A.a", "by", "In", "In!"), ("argument", "A.a", "n", None, "Int"), ("field", "A", "d", "Date", "Date"), ("value", "E", "Y", None, None)} <= got
    assert not any("No" in r or "c" in r or "reason" in r for r in got)


def test_terraform_references():
    text = 'locals {\n  zone = var.z\n}\nresource "aws_vm" "a" {\n  # aws_vm.no.id\n  net = "${data.aws_net.n.id}"\n  x = [local.zone, module.m.out]\n  nested { y = aws_vm.b.id }\n}\noutput "o" { value = aws_vm.a.ip }'
    assert list(schemas._terraform(text)) == [("locals", "local", ["var.z"]), ("resource", "aws_vm.a", ["aws_vm.b", "data.aws_net.n", "local.zone", "module.m"]), ("output", "output.o", ["aws_vm.a"])]


def test_compose(spark):
    pytest.importorskip("yaml")
    good = "services:\n  db: {image: pg, ports: ['5:5']}\n  web:\n    depends_on:\n      db: {condition: healthy}\n    ports: [{target: 80, published: 8080}]\n  x: {depends_on: [y]}\n  y: {depends_on: [x]}\n  empty:\n"
    got = schemas.docker_map(files(spark, good, None, "", ": : [", "services: 3"))
    rows = {r.service: r for r in got.collect()}
    assert rows["db"].image == "pg" and rows["web"].depends_on == ["db"] and rows["web"].ports == ["8080:80"] and rows["empty"].ports == []
    assert {(r.service, r.level) for r in schemas.start_order(got).collect()} == {("db", 0), ("web", 1), ("empty", 0)}


def test_null_and_empty_texts(spark):
    for read in (schemas.proto_schema, schemas.graphql_schema, schemas.terraform_map):
        assert read(files(spark, None, "", "{", "}}", '"')).count() == 0


def test_goals(spark):
    goals = ["audit this codebase", "find LOAD-BEARING files", "security review please", "hardcoded secrets in this repo", "supply chain audit", "dead code cleanup", "look at /opt/foo.dll", "analyze libapp.so", "find all api endpoints", "diff a b", "recon http://x.org", " ", None, "hello"]
    rows = [(g, ["a", "b"] if g == "diff a b" else None) for g in goals]
    got = [r.intent for r in composite.think(spark.createDataFrame(rows, "goal string, paths array<string>")).collect()]
    assert got == ["codebase_audit", "load_bearing", "security_review", "find_secrets", "supply_chain", "dead_code", "reverse_pe", "reverse_elf", "find_endpoints", "diff_binaries", "rejected", "rejected", "rejected", "fallback"]


def test_steps_stop_at_the_first_error(spark):
    seen = []
    actions = {"a": lambda t: seen.append(t), "bad": lambda t: 1 / 0}
    assert composite.parse_steps(" a:x:y, ,bad ") == [("a", "x:y"), ("bad", "")]
    with pytest.raises(RuntimeError, match="step 2, bad"):
        composite.run_steps(actions, composite.parse_steps("a:1,bad,a:2"))
    assert seen == ["1"]
    with pytest.raises(ValueError, match="unknown action nope"):
        composite.run_steps(actions, [("nope", "")])
