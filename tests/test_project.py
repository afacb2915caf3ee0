"""A small tree from end to end."""

from loamline.operators import index
from loamline.project import Project
from loamline.sources import sinks

A = '''import os


def helper(x):
    # TODO: tidy
    return os.getenv("A_KEY")


def serve():
    if helper(1) and helper(2):
        os.system(x)
    return 1


def lonely():
    return 0
'''
DIFF = "diff --git a/a.py b/a.py\n@@ -10 +10 @@\n-x\n+y\n"


def test_project(spark, tmp_path):
    (tmp_path / "a.py").write_text(A)
    (tmp_path / "test_a.py").write_text("from a import serve\n\n\ndef test_serve():\n    serve()\n")
    (tmp_path / ".env.example").write_text("B_KEY=\n")
    p = Project(spark, str(tmp_path))
    col = lambda df, c: sorted(r[c] for r in df.collect())
    assert p.search("lonely").first().path == "a.py"
    assert col(p.query_graph("callers", "a.py::helper"), "qualified_name") == ["a.py::serve"]
    assert col(p.query_graph("tests", "a.py::serve"), "qualified_name") == ["test_a.py::test_serve"]
    assert col(p.query_graph("search", "ser"), "qualified_name") == ["a.py::serve", "test_a.py::test_serve"]
    assert {(r.qualified_name, r.confidence) for r in p.dead_code().collect()} == {("a.py::lonely", "dead")}
    assert {(r.key, r.status) for r in p.env().collect()} == {("A_KEY", "undocumented"), ("B_KEY", "dead")}
    assert {r.rule for r in p.audit().collect()} == {"cmdi"} and p.risk().first().risk == 10
    assert p.audit([("cmdi*", "**")]).count() == 0
    assert col(p.debt(), "kind") == ["TODO"]
    r = p.review(spark.createDataFrame([("d", DIFF)], "path string, text string"))
    assert col(r["symbols"], "symbol") == ["a.py::serve"] and r["findings"].count() == 1 and r["totals"].first().added == 1
    assert "test_a.py::test_serve" in col(r["impact"], "node")
    changed = r["symbols"].selectExpr("symbol as function")
    assert col(p.tests_for(changed), "test") == ["test_a.py::test_serve"]
    assert p.statistics().first().files == 3 or p.statistics().first().files == 2


def test_index_refresh(spark):
    f = spark.createDataFrame([("a.py", "x = 1\n" * 10), ("b.py", "import a\n" * 6), ("c.py", "y = 2\n" * 6)], "path string, text string")
    from pyspark.sql import functions as F

    stored = f.select("path", F.sha2("text", 256).alias("digest")).withColumn("digest", F.when(F.col("path") == "a.py", "old").otherwise(F.col("digest")))
    stored = stored.unionByName(spark.createDataFrame([("gone.py", "z")], "path string, digest string"))
    imports = spark.createDataFrame([("b.py", "a.py")], "src string, dst string")
    assert sorted(r.path for r in index.stale(f, stored, imports).collect()) == ["a.py", "b.py"]
    old = spark.createDataFrame([("c.py", 0, 1, 6, "kept"), ("gone.py", 0, 1, 1, "gone"), ("a.py", 0, 1, 1, "old")], "path string, chunk int, line_start int, line_end int, text string")
    got = {r.path: r.text for r in index.refresh(f, old, stored, imports).collect()}
    assert set(got) == {"a.py", "b.py", "c.py"} and got["c.py"] == "kept" and got["a.py"] != "old"
    e = index.with_context(spark.createDataFrame([("a.py", "t")], "path string, text string"), imports, spark.createDataFrame([("a.py", "os")], "path string, name string")).first()
    assert e.embedding_text == "// Used by: b.py\n// Imports: os\nt"


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = lambda rows: spark.createDataFrame(rows, "file_path string, v int")
    sinks.store_files(df([("a", 1), ("b", 2)]), df([("a", 0), ("b", 0)]), path)
    sinks.store_files(df([("a", 9)]), df([("a", 0)]), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]
    sinks.set_values({"k": "1"}, spark, path + "kv")
    sinks.set_values({"k": "2", "l": "3"}, spark, path + "kv")
    assert sorted(tuple(r) for r in spark.read.parquet(path + "kv").collect()) == [("k", "2"), ("l", "3")]
    sinks.record_saving(spark, path + "s", "2024-01-01 00:00:00", "p", "grep", 200, 50)
    assert spark.read.parquet(path + "s").first().savings_pct == 75.0
    assert sinks.as_json(df([("a", 1)])).first().value == '{"file_path":"a","v":1}'
