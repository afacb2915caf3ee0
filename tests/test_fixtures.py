"""Small graphs, rankings and logs with the results that the contract's fixtures state."""

import pytest
from pyspark.sql import functions as F

from loamline.operators import contracts as C
from loamline.operators import graph as G
from loamline.operators import intervals as I
from loamline.operators import logs as LG
from loamline.operators import lookups as K
from loamline.operators import metrics as M
from loamline.operators import retrieval as R
from loamline.sources import code as S

NODE = "kind string, name string, qualified_name string, file_path string, parent_name string, is_test boolean"
EDGE = "kind string, source_qualified string, target_qualified string, file_path string"


def graph(spark, nodes, edges):
    """nodes: (file, parent, name); edges: (source's file, source, target, kind)."""
    n = [("Function", name, "::".join(x for x in (f, p, name) if x), f, p, name.startswith("test")) for f, p, name in nodes]
    return spark.createDataFrame(n, NODE), spark.createDataFrame([(k, f"{f}::{s}", t, f) for f, s, t, k in edges], EDGE)


def called(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.target, set()).add(r.caller)
    return out


def test_same_name_in_two_crates(spark):
    n, e = graph(
        spark,
        [("crates/a/src/x.rs", "Foo", "connect"), ("crates/b/src/y.rs", "Bar", "connect"), ("crates/a/src/c.rs", None, "ca"), ("crates/b/src/c.rs", None, "cb")],
        [("crates/a/src/c.rs", "ca", "connect", "CALLS"), ("crates/b/src/c.rs", "cb", "connect", "CALLS")],
    )
    got = called(G.callers(n, e))
    assert got == {"crates/a/src/x.rs::Foo::connect": {"crates/a/src/c.rs::ca"}, "crates/b/src/y.rs::Bar::connect": {"crates/b/src/c.rs::cb"}}


def test_common_name_counts_within_its_file(spark):
    n, e = graph(spark, [("a.rs", "T", "path"), ("a.rs", None, "near"), ("b.rs", None, "far")], [("a.rs", "near", "path", "CALLS"), ("b.rs", "far", "path", "CALLS")])
    assert called(G.callers(n, e)) == {"a.rs::T::path": {"a.rs::near"}}


def test_typed_receiver(spark):
    n, e = graph(spark, [("a.rs", "Foo", "new"), ("b.rs", "Bar", "new"), ("c.rs", None, "cc")], [("c.rs", "cc", "Foo::new", "CALLS")])
    assert called(G.callers(n, e)) == {"a.rs::Foo::new": {"c.rs::cc"}}


def test_ambiguous_name(spark):
    n, e = graph(spark, [("a.rs", "Cache", "get"), ("b.rs", "Store", "get"), ("c.rs", None, "uses")], [("c.rs", "uses", "get", "CALLS")])
    assert called(G.callers(n, e)) == {}
    assert called(G.callers(n, e, low_confidence=True)) == {"a.rs::Cache::get": {"c.rs::uses"}, "b.rs::Store::get": {"c.rs::uses"}}
    assert G.callees(n, e).count() == 0
    assert {(r.target, r.confidence) for r in K.low_confidence_callees(n, e).collect()} == {("a.rs::Cache::get", "low"), ("b.rs::Store::get", "low")}


def test_import_evidence(spark):
    n, e = graph(
        spark,
        [("crates/a/src/auth.rs", "Foo", "connect"), ("crates/b/src/net.rs", "Bar", "connect"), ("crates/c/src/c.rs", None, "cc")],
        [("crates/c/src/c.rs", "cc", "connect", "CALLS"), ("crates/c/src/c.rs", "cc", "crates/a/src/auth.rs::Foo", "IMPORTS_FROM")],
    )
    assert called(G.callers(n, e)) == {"crates/a/src/auth.rs::Foo::connect": {"crates/c/src/c.rs::cc"}}


def test_impact_of_chains(spark):
    e = spark.createDataFrame([("CALLS", a, b) for a, b in (("a", "b"), ("b", "c"), ("c", "d"))], "kind string, source_qualified string, target_qualified string")
    seed = lambda x: spark.createDataFrame([(x,)], "node string")
    assert {(r.node, r.min_depth) for r in G.impact_radius(e, seed("a"), 2, 10).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r.truncated for r in G.impact_radius(e, seed("a"), 2, 3).collect()} == {True}
    nothing = spark.createDataFrame([], "node string")
    assert G.impact_radius(e, nothing, 2, 10).count() == 0


def test_fuzzy_rank(spark):
    n = spark.createDataFrame([("connect_all", "x::connect_all"), ("connect", "z::connect"), ("Reconnect", "a::Reconnect")], "name string, qn string")
    assert [r.name for r in R.fuzzy_search(n, "connect", "name", "qn", 10).collect()] == ["connect", "Reconnect", "connect_all"]


def test_coverage(spark):
    e = spark.createDataFrame([("test_t", "A"), ("A", "B")], "src string, dst string")
    m = G.coverage_map(e, spark.createDataFrame([("test_t",)], "test string"))
    assert {(r.function, r.test, r.hops) for r in m.collect()} == {("A", "test_t", 1), ("B", "test_t", 2)}
    e = spark.createDataFrame([("test_broad", x) for x in "ABC"] + [("test_a_only", "A")], "src string, dst string")
    m = G.coverage_map(e, spark.createDataFrame([("test_broad",), ("test_a_only",)], "test string"))
    got = G.suggest_tests(m, spark.createDataFrame([(x,) for x in "ABC"], "function string")).orderBy(F.desc("covers"), "hops", "test")
    assert [(r.test, r.covers) for r in got.collect()] == [("test_broad", 3), ("test_a_only", 1)]


def test_cycle_and_coupling(spark):
    m = spark.createDataFrame([(1,), (2,), (3,)], "path long")
    i = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (3, 99)], "src long, dst long")
    assert {(r.path, r.fan_in, r.fan_out) for r in G.coupling(m, i).collect()} == {(1, 2, 1), (2, 1, 1), (3, 0, 1)}
    assert {(r.node, r.component, r.size) for r in G.scc(i).collect()} == {(1, 1, 2), (2, 1, 2)}


def test_expansion_keeps_the_lowest_hop(spark):
    n, e = graph(spark, [("f.py", None, x) for x in "abcd"], [("f.py", "a", "b", "CALLS"), ("f.py", "b", "c", "CALLS"), ("f.py", "a", "c", "CALLS"), ("f.py", "c", "a", "CALLS"), ("f.py", "c", "d", "CALLS")])
    got = {r.node[-1]: r.hops for r in G.expand_calls(n, e, spark.createDataFrame([("f.py::a",)], "node string"), 3).collect()}
    assert got == {"b": 1, "c": 1, "d": 2}
    ctx = spark.createDataFrame([("c1", 2, 5), ("c1", 1, 9), ("c2", 1, 3)], "chunk string, hops int, line int")
    assert [(r.chunk, r.hops) for r in R.nearest_context(ctx, ["chunk"], ["line", "chunk"]).collect()] == [("c2", 1), ("c1", 1)]


def ranks(spark, ids):
    return spark.createDataFrame([(i, 1.0 - k / 100) for k, i in enumerate(ids)], "id long, score double")


def test_rrf(spark):
    both = lambda w: [r.id for r in R.rrf([(ranks(spark, [1, 2, 3]), 1.0), (ranks(spark, [3, 2]), w)]).collect()]
    assert both(1.0)[0] == 3 and both(1.0)[-1] == 1 and both(2.0)[0] == 3
    assert [r.id for r in R.rrf([(ranks(spark, [1, 2]), 1.0), (ranks(spark, [2, 1]), 1.0)]).collect()] == [1, 2]
    assert [r.id for r in R.rrf([(ranks(spark, [7, 3, 9]), 1.0), (ranks(spark, []), 1.0)]).collect()] == [7, 3, 9]


def test_query_forms():
    assert R.query_terms("stop_unix_process_group") == ["stop_unix_process_group"]
    assert R.query_terms("how do we authenticate users") == ["how", "do", "we", "authenticate", "users"]
    assert R.query_terms("?!") == []
    assert R.query_terms("a fn x of") == ["fn", "of"]
    assert R.query_terms("foo() OR bar-baz") == ["foo", "or", "bar", "baz"]
    assert [R.is_identifier(x) for x in ("snake_case", "CamelCase", '"quoted words"', "lowercase", "HTTP", " ")] == [True, True, True, False, False, False]


def test_lexical_exact(spark):
    df = spark.createDataFrame([(1, "fn stop() {}"), (2, "pub fn stop_unix_process_group(pid)"), (3, "unix process group")], "id long, text string")
    assert [r.id for r in R.bm25(df, R.query_terms("stop_unix_process_group"), "id", "text").collect()] == [2]


def test_cosine_and_similarity_graph(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(R.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == pytest.approx([1.0, 0.0, 0.0])
    v = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.99, 0.01, 0.0]), (2, [0.0, 0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.a, r.b) for r in R.similarity_edges(v, 0.72).collect()] == [(0, 1)]


def test_cliques_are_communities(spark):
    e = [(a, b, 0.9) for g in ((1, 2, 3), (4, 5, 6)) for a in g for b in g if a < b]
    got = {r.node: r.community for r in K.communities(spark.createDataFrame(e, "a long, b long, weight double")).collect()}
    assert got[1] == got[2] == got[3] != got[4] == got[5] == got[6]


def test_chunker():
    two = list(S.chunk("a.rs", "fn a() {\n  1\n}\n\nfn b() {\n  2\n}\n"))
    assert len(two) == 2 and "fn a" in two[0][4] and "fn b" in two[1][4]
    long = list(S.chunk("a.rs", "fn big() {\n" + "  x();\n" * 200 + "}\n"))
    assert len(long) >= 2 and "(continued)" in long[1][4]
    assert [(c[2], c[3]) for c in S.chunk("a.unknown", "\n".join("x" for _ in range(80)))] == [(1, 40), (41, 80)]
    assert len(list(S.chunk("a.txt", "tiny"))) == 1


def test_savings(spark):
    e = spark.createDataFrame([("app-a", "log_filter", 100, 30, 70.0), ("app-a", "log_filter", 200, 50, 75.0), ("app-b", "search", 50, 10, 80.0)], "project string, op string, o long, f long, pct double")
    cols = F.col("o"), F.col("f"), F.col("pct")
    total = M.savings(e, *cols).first()
    assert (total.operations, total.lines_saved) == (3, 260.0)
    assert M.savings(e, *cols, "project").count() == 2 == M.savings(e, *cols, "op").count()


@pytest.mark.parametrize(
    "a, b, want",
    [
        ((5, 8.0, 0, 0, 0.0), (2, 5.0, 0, 0, 0.0), "improving"),
        ((2, 5.0, 0, 0, 0.0), (8, 12.0, 4, 0, 0.0), "degrading"),
        ((3, 4.0, 1, 0, 50.0), (3, 4.0, 1, 0, 50.0), "stable"),
    ],
)
def test_debt_trend(spark, a, b, want):
    df = spark.createDataFrame([tuple(float(y - x) for x, y in zip(a, b, strict=True))], "anti double, cc double, god double, cyc double, cov double")
    assert df.select(M.trend(*(F.col(c) for c in df.columns)).alias("t")).first().t == want


def keys(spark, xs, side):
    return spark.createDataFrame([(x, side) for x in xs], f"key string, {side} string")


def test_contract_drift(spark):
    p = keys(spark, ["Auth.Login", "Auth.Logout"], "producer")
    got = {r.key: r.status for r in C.drift(p, keys(spark, ["Auth.Refresh", "Auth.Login"], "consumer"), F.split_part("key", F.lit("."), F.lit(1))).collect()}
    assert got == {"Auth.Refresh": "violation", "Auth.Login": "matched"}
    service = F.split_part(F.split_part("key", F.lit(" "), F.lit(2)), F.lit("/"), F.lit(3))
    rest = {r.key: r.status for r in C.drift(keys(spark, ["PATCH /api/orders/{param}"], "producer"), keys(spark, ["PUT /api/orders/{param}", "POST /v1/charges"], "consumer"), service).collect()}
    assert rest == {"PUT /api/orders/{param}": "violation", "POST /v1/charges": "external"}


def test_rest_keys(spark):
    df = spark.createDataFrame([("https://h.example/api/orders/123/",), ("/API/orders/{id}?x=1",), ("/",)], "u string")
    assert [r.k for r in df.select(C.rest_path(F.col("u")).alias("k")).collect()] == ["/api/orders/{param}", "/api/orders/{param}", "/"]
    p, c = keys(spark, ["GET /api/orders/{param}", "GET /{param}/{param}"], "producer"), keys(spark, ["GET /api/orders/latest"], "consumer")
    assert {(r.producer_key, r.consumer_key) for r in C.param_links(p, c).collect()} == {("GET /api/orders/{param}", "GET /api/orders/latest")}


def test_log_fixtures(spark):
    rows = lambda xs: spark.createDataFrame([("s", k, x) for k, x in enumerate(xs)], "file string, line long, content string")
    out = lambda xs, **kw: [r.content for r in LG.quiet(rows(xs), **kw).orderBy("position").collect()]
    assert out(["hello"] * 3 + ["world"]) == ["hello (×3)", "world"]
    assert out(["a", "b", "b"]) == ["a", "b (×2)"]
    assert len(out([f"line {k}" for k in range(200)])) == 51
    levels = ["INFO a", "DEBUG b", "WARN c", "ERROR d", "INFO e"]
    assert out(levels) == ["WARN c", "ERROR d"] and out(levels, compact=False) == levels
    assert I.head_tail(rows([str(k) for k in range(200)]), ["file"], ["line"]).count() == 50
