"""Stores, linters' reports, services, interface descriptions and models."""

import json

import pytest
from pyspark.sql import functions as F

from loamline.sources import documents as D
from loamline.sources import linters as L
from loamline.sources import services as V
from loamline.sources import stores as S


def test_linters(spark):
    reports = {
        "ruff": json.dumps([{"code": c, "message": "m", "filename": "/p/a.py", "location": {"row": 3, "column": 1}} for c in ("F841", "E501", "B006", "N801", "S101", "UP006", "RUF005", "D100")]),
        "clippy": "\n".join(json.dumps(x) for x in ({"reason": "compiler-message", "message": {"level": "warning", "code": {"code": "clippy::perf"}, "rendered": "slow\nmore", "spans": [{"file_name": "a.rs", "line_start": 4, "column_start": 2}]}}, {"reason": "build", "message": {}}, {"reason": "compiler-message", "message": {"level": "error", "code": {"code": "E1"}, "message": "bad"}})) + "\nnot json",
        "golangci-lint": json.dumps({"Issues": [{"FromLinter": x, "Text": "t", "Pos": {"Filename": "q.go", "Line": 87, "Column": 2}} for x in ("errcheck", "gosec", "revive", "unused")]}),
        "dart-analyze": "INFO|LINT|avoid_print|/p/lib/a.dart|42|5|14|Avoid print calls.\nshort|line\nERROR|X|close_sinks|b.dart|x|1|1|m",
        "oxlint": "\n".join(json.dumps(x) for x in ({"ruleId": "jsx-a11y/alt", "severity": "error", "message": "m", "filename": "a.tsx", "line": 1, "column": 2}, {"rule_id": "no-unused-vars", "start": {"line": 5, "column": 1}})),
        "eslint-plugin-vue": json.dumps([{"filePath": "/p/src/A.vue", "messages": [{"ruleId": "vue/require-prop", "severity": 2, "message": "m", "line": 2, "column": 3}, {"ruleId": None, "severity": 1}]}, {"filePath": "b"}]),
        "other": "[]",
        "react-doctor": json.dumps({"score": {"score": 82}, "diagnostics": [{"ruleId": "react/no-danger", "severity": "error", "file": "r.tsx", "line": 10, "category": "correctness"}]}),
        "angular-eslint": "no json",
    }
    got = {(r.rule, r.tool, r.category, r.severity, r.file, r.line) for r in L.linter_findings(spark.createDataFrame([*reports.items(), ("ruff", None)], "tool string, text string"), "/p").collect()}
    ruff = {("F841", "correctness", "important"), ("E501", "style", "warning"), ("B006", "correctness", "important"), ("N801", "style", "suggestion"), ("UP006", "idiom", "suggestion"), ("RUF005", "idiom", "warning"), ("D100", "style", "suggestion")}
    want = {(f"ruff:{c}", "ruff", k, v, "a.py", 3) for c, k, v in ruff}
    want |= {("clippy::perf", "clippy", "performance", "warning", "a.rs", 4), ("E1", "clippy", "idiom", "important", "", None)}
    want |= {(f"go:{x}", "golangci-lint", k, v, "q.go", 87) for x, k, v in (("errcheck", "correctness", "important"), ("revive", "style", "suggestion"), ("unused", "dead_code", "warning"))}
    want |= {("dart:avoid_print", "dart-analyze", "style", "suggestion", "lib/a.dart", 42), ("dart:close_sinks", "dart-analyze", "correctness", "important", "b.dart", None)}
    want |= {("oxlint:jsx-a11y/alt", "oxlint", "accessibility", "important", "a.tsx", 1), ("oxlint:no-unused-vars", "oxlint", "dead_code", "warning", "", 5)}
    want |= {("eslint:vue/require-prop", "eslint-plugin-vue", "correctness", "important", "src/A.vue", 2), ("eslint:unknown", "eslint-plugin-vue", "style", "warning", "src/A.vue", None)}
    want |= {("react/no-danger", "react-doctor", "correctness", "important", "r.tsx", 10)}
    assert got == want
    ox = {r: next(L.oxlint(json.dumps([{"ruleId": r}])))[2] for r in ("no-eval", "react/jsx-key", "import/no-cycle", "max-lines", "x")}
    assert ox == {"no-eval": "correctness", "react/jsx-key": "idiom", "import/no-cycle": "bundle_size", "max-lines": "complexity", "x": "style"}


def test_services(spark):
    rows = [
        (".env", "DATABASE_URL=x\nREDIS_HOST=y\n# STRIPE_KEY=z\nMY_AWS_REGION=e\nBACKEND_API_URL=http://localhost:8080/v1\nPORTAL_URL='http://127.0.0.1:9000'\nGOOGLE_CLOUD_PROJECT=p"),
        ("compose.yml", "services:\n  db:\n    image: mariadb:10\n  q:\n    image: RabbitMQ"),
        ("src/a.ts", "fetch('https://api.stripe.com/v1'); get(\"http://localhost:8080/users/me/x\"); `https://x.example.com/`; 'http://db.internal/x'; 'https://${host}/y'"),
        ("b.md", "'https://api.other.org/'"),
        ("c.py", None),
    ]
    got = {r.service: r.path for r in V.external_services(spark.createDataFrame(rows, "path string, text string"), {8080: "web"}).collect()}
    assert got == {
        "PostgreSQL": ".env", "Redis": ".env", "AWS S3": ".env", "GCP": ".env", "Internal APIs": ".env", "→ web (BACKEND_API_URL)": ".env", "Internal: PORTAL :9000": ".env",
        "MySQL": "compose.yml", "RabbitMQ": "compose.yml", "API: stripe.com": "src/a.ts", "→ web (/users/me/…)": "src/a.ts",
    }


SWAGGER = """openapi: 3.0.0
paths:
  '/users/{id}':
    # a comment
    get:
      summary: 'One user'
      tags:
        - users
    delete:
      tags: [admin, users]
  /health:
    post:
      description: none
"""


def test_swagger(spark):
    got = D.documented_routes(spark.createDataFrame([("api.yml", SWAGGER), ("e.yml", ""), ("n.yml", None)], "path string, text string"))
    assert {tuple(r) for r in got.collect()} == {("api.yml", "GET", "/users/{id}", "One user", "users"), ("api.yml", "DELETE", "/users/{id}", None, "admin"), ("api.yml", "POST", "/health", None, None)}
    own = spark.createDataFrame([("GET", "/users/{id}"), ("PUT", "/x")], "method string, route string")
    assert {tuple(r) for r in D.with_documentation(own, got).collect()} == {("GET", "/users/{id}", "code", "One user", "users"), ("PUT", "/x", "code", None, None), ("DELETE", "/users/{id}", "swagger", None, "admin"), ("POST", "/health", "swagger", None, None)}


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("a.js", "const U = sequelize.define('User', {\n  name: DataTypes.STRING(40),\n  age: { type: DataTypes.INTEGER, allowNull: false },\n}, { timestamps: true });", [("User", "name", "STRING"), ("User", "age", "INTEGER")]),
        ("b.ts", "sequelize.define<I>(\n  'Post',\n  { title: { allowNull: true, type: Sequelize.TEXT } })", [("Post", "title", "TEXT")]),
        ("c.ts", "Tag.init({ label: DataTypes.STRING }, { sequelize })", [("Tag", "label", "STRING")]),
        ("d.dart", "class Todos extends Table {\n  IntColumn get id => integer().autoIncrement()();\n  TextColumn get title => text()();\n}\nclass Other {}", [("Todos", "id", "int"), ("Todos", "title", "text")]),
        ("e.dart", "class Open extends Table {", []),
    ],
)
def test_models(path, text, want):
    assert [r[1:] for r in D.model_rows(path, text)] == want


def test_advisories():
    npm = json.dumps({"vulnerabilities": {"a": {"severity": "moderate"}, "b": {"severity": "critical"}, "c": {"severity": "info"}}})
    assert [r[1:3] for r in D.advisories("p", npm)] == [("a", "medium"), ("b", "critical"), ("c", "low")]
    pip = json.dumps({"dependencies": [{"name": "x", "vulns": [{"id": "CVE-1"}]}, {"name": "y"}]})
    assert [r[1:] for r in D.advisories("p", pip)] == [("x", "high", "CVE-1")]
    cargo = '{"advisory": {"id": "RUSTSEC-1"}, "package": {"name": "r"}}\n{"other": 1}\n{"advisory": {"id": "GHSA-2"}, "package": {"name": "s"}}'
    assert [r[1:] for r in D.advisories("p", cargo)] == [("r", "high", "RUSTSEC-1"), ("s", "medium", "GHSA-2")]
    go = '{"config": {}}\n{"finding": {"osv": "GO-2", "trace": [{"module": "m"}]}}\n{"finding": {}}'
    assert [r[1:] for r in D.advisories("p", go)] == [("m", "high", "GO-2"), ("unknown", "high", "GO-????")]
    assert list(D.advisories("p", "nothing")) == []


def test_stores(spark, tmp_path):
    base = f"file://{tmp_path}"
    assert S.open_chunks(spark, base + "/none").count() == 0 and S.open_graph(spark, base + "/g")[0].columns[0] == "qualified_name"
    old = spark.createDataFrame([(1, "a.py", 0, "x"), (2, "a.py", 1, "y"), (3, "b.py", 0, "z")], "chunk_id long, file_path string, chunk int, text string")
    old.write.parquet(base + "/c")
    old.withColumn("digest", F.lit("d")).withColumn("extra", F.lit(1)).filter("chunk_id = 3").withColumn("chunk_id", F.lit(4).cast("long")).write.mode("append").parquet(base + "/c")
    got = S.open_chunks(spark, base + "/c")
    assert got.columns == [x.split()[0] for x in S.CHUNKS.split(", ")]
    assert {r.chunk_id: len(r.digest) for r in got.collect()} == {1: 64, 2: 64, 3: 64, 4: 1}
    order = {r.chunk_id: r.position for r in S.chunk_order(old).collect()}
    assert sorted(order.values()) == [0, 1, 2] and order[2] == order[1] + 1
    S.save_communities(spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "chunk_id long, community int"), base + "/m")
    assert {tuple(r) for r in spark.read.parquet(base + "/m").collect()} == {(1, 7, 2), (2, 7, 2), (3, 8, 1)}
    assert S.folder_bytes(spark, base + "/m") > 0 == S.folder_bytes(spark, base + "/none")
    assert S.delete_index(spark, base + "/m") and not S.delete_index(spark, base + "/m")
    asked = spark.createDataFrame([("HEAD:a",), ("HEAD:b",), ("HEAD:a",)], "spec string")
    assert {tuple(r) for r in S.objects(asked, spark.createDataFrame([("HEAD:a", "x"), ("q", "y")], "spec string, content string")).collect()} == {("HEAD:a", "x"), ("HEAD:b", None)}


def test_cache_by_hash(spark, tmp_path):
    path, calls = f"file://{tmp_path}/cache", []
    files = lambda rows: spark.createDataFrame(rows, "path string, text string")

    def make(df):
        calls.append(sorted(r.path for r in df.collect()))
        return df.select("path", F.explode(F.split("text", " ")).alias("word")).filter("word <> ''")

    words = lambda rows: {tuple(r) for r in S.cached(spark, files(rows), path, "path string, word string", make).collect()}
    assert words([("a", "x y"), ("b", "z"), ("c", "")]) == {("a", "x"), ("a", "y"), ("b", "z")}
    assert words([("a", "x y"), ("b", "w"), ("c", "")]) == {("a", "x"), ("a", "y"), ("b", "w")}
    assert words([("b", "w")]) == {("b", "w")}
    assert calls == [["a", "b", "c"], ["b"], []]


def test_registry(spark):
    text = '[[projects]]\nname = "p"\npath = "/w/p"\n[[projects.services]]\nname = "web"\ncommand = "run \\"x\\""\nport = 80\n[[projects.services]]\nname = "db"\nworking_dir = "/w/p/db"\n[[projects]]\nname = "q"\npath = "C:\\\\q"\n'
    got = S.registry(spark, text)
    rows = {tuple(r) for r in got.collect()}
    assert rows == {("p", "/w/p", None, None, "web", 'run "x"', None, 80), ("p", "/w/p", None, None, "db", None, "/w/p/db", None), ("q", "C:\\q", None, None, None, None, None, None)}
    assert {tuple(r) for r in S.registry(spark, S.registry_text(got)).collect()} == rows
