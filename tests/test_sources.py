"""Parsers, scans and the operators that the queries don't reach, on small texts."""

import pytest
from pyspark.sql import functions as F

from loamline.functions import scalars
from loamline.operators import contracts, graph, incremental, intervals, metrics, retrieval
from loamline.sources import code, coverage, documents, files, history
from loamline.streaming import logs

PY = '''import os
from pkg.util import helper

class Box:
    def open(self):
        if self.x and self.y:
            return self.close()
        return helper(1)

    def close(self):
        return os.getenv("BOX_KEY")

def serve():
    Box().open()
'''


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in {
        "src/box.py": PY, "src/test_box.py": "def test_open():\n    serve()\n", "src/app.js": "app.get('/users/:id', h)\nconst a = () => process.env.API_URL\n", "node_modules/x/index.js": "x" * 700_000,
        ".env": "BOX_KEY=1\nexport UNUSED=2\n# C=3\n", "id_rsa": "k", "a.min.js": "y", "package.json": '{"name": "my_app"}', "lcov.info": "SF:src/box.py\nLF:10\nLH:7\nend_of_record\n", "coverage.out": "mode: set\na.go:1.1,2.2 3 1\na.go:3.1,4.2 2 0\n",
        "docker-compose.yml": "services:\n  db:\n    image: pg:1\n  web:\n    build: .\n", "main.tf": 'resource "aws_s3_bucket" "b" {}\n',
    }.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_scan(spark, tree):
    got = {r.path: r.language for r in files.scan(spark, tree).collect()}
    assert got["src/box.py"] == "python" and got["src/app.js"] == "javascript"
    assert not {"node_modules/x/index.js", ".env", "id_rsa", "a.min.js"} & set(got)
    assert "src/app.js" not in {r.path for r in files.scan(spark, tree, ignore=["*.js", "# no"]).collect()}
    assert rows(files.dominant_language(files.scan(spark, tree)), "language") == [("python",)]
    assert rows(files.space(spark, tree), "folder", "files") == [("node_modules", 1)]


def test_env_and_packages(spark, tree):
    f = files.scan(spark, tree, sensitive=True)
    keys = files.env_keys(files.hidden(spark, tree, ".env*")).select("key")
    assert files.hidden(spark, tree, ".none").count() == 0
    reads = files.env_reads(f)
    assert rows(keys, "key") == [("BOX_KEY",), ("UNUSED",)]
    assert rows(reads, "key") == [("API_URL",), ("BOX_KEY",)]
    assert rows(reads.join(keys, "key", "left_anti"), "key") == [("API_URL",)]
    assert rows(files.package_names(f), "package") == [("my_app",)]


def test_code(spark, tree):
    f = files.scan(spark, tree)
    n, e = code.call_graph(f)
    assert {r.qualified_name for r in n.filter("kind <> 'File'").collect()} >= {"src/box.py::Box", "src/box.py::Box::open", "src/box.py::serve", "src/test_box.py::test_open"}
    assert ("src/box.py::Box::open", "src/box.py::Box::close") in {(r.source_qualified, r.target_qualified) for r in e.filter("kind = 'CALLS'").collect()}
    assert ("src/box.py::serve", "src/test_box.py::test_open") in set(rows(graph.callers(n, e), "target", "caller"))
    assert ("src/test_box.py::test_open", "src/box.py::serve") in set(rows(graph.callees(n, e), "caller", "target"))
    assert "src/box.py::Box::close" not in {r.qualified_name for r in graph.dead_nodes(n, e).collect()}
    assert ("open", 3) in set(rows(code.complexity(f), "name", "complexity"))
    m = {r.path: r for r in code.modules(f).collect()}
    assert m["src/box.py"].imports == ["os", "pkg.util"] and m["src/box.py"].classes == 1


def test_chunks():
    got = code.line_chunks(["x"] * 34 + [""] + ["x"] * 60)
    assert got[0] == (0, 35) and got[-1][1] == 95 and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert code.line_chunks(["x"] * 43) == [(0, 43)]
    long = "def f():\n" + "    x = 1\n" * 200
    parts = list(code.chunk("a.py", long))
    assert [p[2] for p in parts] == [1, 81, 161] and "(continued)" in parts[1][4]


def test_coverage(spark, tree):
    got = coverage.reports(files.scan(spark, tree))
    assert rows(got, "report", "file", "total", "hit") == [("coverage.out", "a.go", 5, 3), ("lcov.info", "src/box.py", 10, 7)]
    assert rows(coverage.first_report(got), "report") == [("lcov.info",)]
    assert list(coverage.cobertura("c", '<coverage><class filename="a"><lines><line hits="1"/><line hits="0"/></lines></class><class filename="b" line-rate="0.5"/></coverage>')) == [("c", "a", 2, 1), ("c", "b", 100, 50)]
    assert list(coverage.istanbul("c", '{"total": {}, "a.js": {"lines": {"total": 4, "covered": 3}}, "b.js": {"s": {"0": 1, "1": 0}}}')) == [("c", "a.js", 4, 3), ("c", "b.js", 2, 1)]
    assert list(coverage.parse("coverage.xml", "<broken")) == []


DIFF = """diff --git a/a.py b/a.py
--- a/a.py
+++ b/a.py
@@ -3,0 +4,2 @@ def f
+x
+y
@@ -9 +11 @@
-q
+r
diff --git a/old.py b/new.py
rename from old.py
rename to new.py
diff --git a/gone.py b/gone.py
deleted file mode 100644
@@ -1,2 +0,0 @@
-a
-b
"""


def test_history(spark, tmp_path):
    assert [x[1:] for x in history.parse_diff("d", DIFF)] == [("a.py", "a.py", "modified", 4, 5, 2, 0), ("a.py", "a.py", "modified", 11, 11, 1, 1), ("new.py", "old.py", "renamed", None, None, 0, 0), ("gone.py", "gone.py", "deleted", 1, 1, 0, 2)]
    (tmp_path / "log").write_text("\x1e".join("\x1f".join(x) for x in [("c1", "2024-01-02", "A", "feat(core): Add x", "Closes #12"), ("c2", "2024-01-03", "B", "Tidy", "")]) + "\x1e")
    got = rows(history.work_log(spark, str(tmp_path / "log")), "commit", "ctype", "scope", "subject", "resolves")
    assert got == [("c1", "feat", "core", "Add x", ["12"]), ("c2", "other", None, "Tidy", [])]
    stat = history.numstat(spark.createDataFrame([("3\t1\ta.py",), ("-\t-\tb.png",)], "value string"))
    assert rows(history.commit_totals(stat), "files", "added", "removed") == [(2, 3, 1)]
    names = spark.createDataFrame([("a.py",)], "value string")
    assert rows(history.changed_files(names, spark.createDataFrame([("R  b.py -> c.py",), (" M a.py",)], "value string")), "path") == [("a.py",), ("c.py",)]
    assert rows(history.commit_type(spark.createDataFrame([("README.md", "modified")], "path string, status string")), "ctype") == [("docs",)]


BOARD = "# B\n## Todo\n- **T-1** First thing `prio:high` `#x` `2024-05-01`\n  - src/a.py\n- **T-2** Other\n## Done\n- **T-3** Old\n"


def test_board(spark):
    f = spark.createDataFrame([("b.md", BOARD)], "path string, text string")
    b = documents.boards(f)
    assert rows(b, "column", "task", "title", "priority", "due", "tags", "links")[1] == ("Todo", "T-1", "First thing", "high", "2024-05-01", ["x"], ["src/a.py"])
    text = documents.board_text(b).first().value
    again = documents.boards(spark.createDataFrame([("b.md", text)], "path string, text string"))
    assert rows(again, *b.columns) == rows(b, *b.columns)
    snaps = spark.createDataFrame([(1, "a", "Todo"), (2, "a", "Todo"), (3, "a", "Done"), (1, "b", "Todo"), (3, "b", "Todo")], "seq int, task string, column string")
    assert rows(documents.board_history(snaps), "task", "seq", "column") == [("a", 1, "Todo"), ("a", 3, "Done"), ("b", 1, "Todo"), ("b", 2, "(removed)"), ("b", 3, "Todo")]


def test_documents(spark, tree):
    f = files.scan(spark, tree)
    assert ("GET", "/users/:id") in set(rows(documents.api_routes(f), "method", "route"))
    assert set(rows(documents.infrastructure(f), "kind", "name")) >= {("service", "db"), ("service", "web"), ("image", "db"), ("resource", "b")}
    m = list(documents.model_rows("m.py", "class User(Base):\n    id = Column(Integer)\n    team_id = Column(ForeignKey)\n")) + list(documents.model_rows("m.proto", "message A {\n  string name = 1;\n}\n"))
    assert m == [("m.py", "User", "id", "Integer"), ("m.py", "User", "team_id", "ForeignKey"), ("m.proto", "A", "name", "string")]
    assert list(documents.advisories("a", '{"vulnerabilities": {"left-pad": {"severity": "high"}}}')) == [("a", "left-pad", "high", "")]


def test_retrieval_rules():
    assert retrieval.is_identifier("get_user") and retrieval.is_identifier("getUser") and retrieval.is_identifier('"a b"') and not retrieval.is_identifier("two words")
    assert retrieval.query_terms("how a_b works") == ["how", "a_b", "works"] and retrieval.query_terms("getUser") == ["getuser"]
    assert retrieval.query_allowed("one", "bm25") and not retrieval.query_allowed("one")
    assert [retrieval.search_mode(m) for m in ("bm25", "vector", None)] == ["lexical", "vector", "hybrid"]
    assert retrieval.glob_regex("src/**/*.py") == r"^src/.*[^/]*\.py$"


def test_hybrid(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, None)], "doc_id long, text string")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = retrieval.hybrid(docs, vec, "alpha words", [0.0, 1.0], 5).orderBy("id").collect()
    assert [(r.id, r.cosine) for r in got] == [(1, 0.0), (2, 1.0)]
    assert [r.cosine for r in retrieval.hybrid(docs, vec, "alpha", [0.0, 1.0], 5, "lexical").collect()] == [0.0]


def test_impact_cap_and_kind(spark):
    e = spark.createDataFrame([("CALLS", "a", "b"), ("CALLS", "b", "c"), ("IMPORTS_FROM", "c", "d"), ("CALLS", "x", "a")], "kind string, source_qualified string, target_qualified string")
    s = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.impact_radius(e, s, 2, 10), "node", "min_depth", "truncated") == [("a", 0, False), ("b", 1, False), ("c", 2, False), ("x", 1, False)]
    assert rows(graph.impact_radius(e, s, 2, 4), "truncated") == [(True,)] * 4
    assert rows(graph.impact_radius(e, s, 3, 10, None), "node")[-2:] == [("d",), ("x",)]


def test_scc(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1)], "src int, dst int")
    assert rows(graph.scc(e), "node", "component", "size") == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 2), (5, 4, 2)]
    assert graph.scc(e.limit(0)).count() == 0


def test_contract_helpers(spark):
    p = spark.createDataFrame([("src/app/x.ts",), ("lib/y.ts",)], "path string")
    pre = spark.createDataFrame([("src",), ("src/app",)], "root string")
    assert rows(contracts.longest_prefix(p, pre, "path", "root"), "path", "root") == [("lib/y.ts", None), ("src/app/x.ts", "src/app")]
    cov = spark.createDataFrame([("app/x.ts", 50.0)], "file string, pct double")
    assert rows(contracts.suffix_join(p, cov, "path", "file", ["pct"]), "path", "pct") == [("lib/y.ts", None), ("src/app/x.ts", 50.0)]
    imp = spark.createDataFrame([("a", ["m/none", "lib/y.ts", "src/app/x.ts"])], "src string, c array<string>")
    assert rows(contracts.first_existing(imp, p, ["src"], "c", "path"), "resolved") == [("lib/y.ts",)]


def test_incremental(spark):
    r = spark.createDataFrame([("a", True, True, None, None, 1.0, 2.0), ("b", False, True, "x", "x", 9.0, 2.0), ("c", False, True, "x", "y", 1.0, 2.0), ("d", False, True, None, None, 3.0, 2.0)], "k string, git_unchanged boolean, indexed boolean, hash string, stored_hash string, mtime double, stored_mtime double")
    assert rows(incremental.skip(False, r), "k", "skip") == [("a", True), ("b", True), ("c", False), ("d", False)]
    assert {x for _, x in rows(incremental.skip(True, r), "k", "skip")} == {False}
    old = spark.createDataFrame([("f", 1), ("g", 2)], "file_path string, v int")
    new = spark.createDataFrame([("f", 9)], "file_path string, v int")
    assert rows(incremental.replace_files(old, new, new), "file_path", "v") == rows(incremental.upsert(old, new, ["file_path"]), "file_path", "v") == [("f", 9), ("g", 2)]


def test_islands_with_nulls(spark):
    r = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "a"), (1, 4, "a"), (1, 5, None)], "k int, t int, v string")
    assert sorted((x.island, x.v, x.n) for x in intervals.islands(r, ["k"], ["t"], "v").collect()) == [(1, None, 2), (2, "a", 2), (3, None, 1)]


def test_scores(spark):
    f = spark.createDataFrame([("critical", "certain")] * 6, "severity string, confidence string")
    assert metrics.risk_score(f).first().risk == 100 and metrics.risk_score(f.limit(0)).first().risk == 0
    z = F.lit(0)
    got = spark.range(1).select(metrics.trend(F.lit(1), z, z, z, z).alias("a"), metrics.trend(z, z, z, z, F.lit(4)).alias("b"), metrics.trend(z, F.lit(1), z, z, z).alias("c")).first()
    assert tuple(got) == ("degrading", "improving", "stable")


def test_scalars(spark):
    s = spark.createDataFrame([("see http://0.0.0.0:3000/x now",)], "s string")
    got = s.select(scalars.url_in(F.col("s")).alias("u"), scalars.truncated(F.col("s"), 8).alias("t"), scalars.html_escape(F.lit("<a&b>")).alias("h"), scalars.safe_id(F.lit("a-b.c")).alias("i"), scalars.last_two_parts(F.lit("a/b/c")).alias("l"), scalars.service_type(F.lit(5432)).alias("p")).first()
    assert tuple(got) == ("http://localhost:3000/x", "see h...", "&lt;a&amp;b&gt;", "a_b_c", "b/c", "database")


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "x")], "t int, k string, line string").coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("t int, k string, line string").parquet(src)
    assert rows(logs.drain(spark, logs.collapsed(stream(), "k", "line", "t"), "append"), "k", "line", "n") == [("a", "x", 2)]
    assert rows(logs.drain(spark, logs.buffers(stream(), "k", "line", "t", 2), "update"), "k", "lines") == [("a", ["x", "y"]), ("b", ["x"])]
    assert rows(logs.drain(spark, logs.latest(stream(), "k", ["t"], {"last": "line"}), "complete"), "k", "last") == [("a", "y"), ("b", "x")]
    codes = str(tmp_path / "codes")
    spark.createDataFrame([(1, "a", None), (2, "a", 1), (1, "b", 0)], "t int, k string, code int").coalesce(1).write.parquet(codes)
    assert rows(logs.drain(spark, logs.states(spark.readStream.schema("t int, k string, code int").parquet(codes), "k", "code", "t"), "update"), "k", "state") == [("a", "failed"), ("b", "stopped")]
    assert rows(logs.drain(spark, logs.subscription(stream(), "k", ["b"]), "append"), "t", "k") == [(4, "b")]
    assert logs.drain(spark, logs.subscription(stream(), "k", None), "append").count() == 4


def test_background_jobs(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1,)], "t int").write.parquet(src)
    jobs = {}
    begin = lambda col, trigger: lambda: spark.readStream.schema("t int").parquet(src).select(col).writeStream.format("noop").trigger(**trigger).start()
    assert logs.job_state(spark, "index", jobs) == "idle"
    assert logs.start_once(spark, "index", jobs, begin(F.col("t"), {"processingTime": "1 hour"}))
    assert not logs.start_once(spark, "index", jobs, begin(F.col("t"), {"availableNow": True})) and logs.job_state(spark, "index", jobs) == "running"
    jobs["index"].stop()
    assert logs.start_once(spark, "index", jobs, begin(F.col("t"), {"availableNow": True}))
    jobs["index"].awaitTermination()
    assert logs.job_state(spark, "index", jobs) == "completed"
    logs.start_once(spark, "index", jobs, begin(F.raise_error(F.lit("no")).cast("int"), {"availableNow": True}))
    try:
        jobs["index"].awaitTermination()
    except Exception as e:
        assert "no" in str(e)
    assert logs.job_state(spark, "index", jobs) == "failed"
