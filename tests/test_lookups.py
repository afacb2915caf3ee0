"""Lookups that have no SQL, against plain versions."""

import itertools
import random

import numpy as np
import pytest

from loamline.operators import graph as G
from loamline.operators import lookups as K
from loamline.plans import registry


def links(groups, size, inside, across, seed):
    rng = random.Random(seed)
    out = []
    for x, y in itertools.combinations(range(groups * size), 2):
        if rng.random() < (inside if x // size == y // size else across):
            out.append((x, y, 1.0))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_modularity(seed):
    """Planted groups are found, and no single move gains."""
    e = links(5, 12, 0.6, 0.03, seed)
    a, b, w = (np.array(x) for x in zip(*e, strict=True))
    label = K.moved(60, a, b, w)
    planted = np.arange(60) // 12
    assert len(set(zip(label.tolist(), planted.tolist(), strict=True))) == 5 == len(set(label.tolist()))
    best = K.modularity(a, b, w, label)
    assert best == pytest.approx(K.modularity(a, b, w, planted))
    for v in range(60):
        for c in set(label.tolist()):
            other = label.copy()
            other[v] = c
            assert K.modularity(a, b, w, other) <= best + 1e-12
    assert K.moved(3, np.zeros(0, int), np.zeros(0, int), np.zeros(0)).tolist() == [0, 1, 2]


def test_communities(spark, sf_dir):
    rows = [(100 + x, 100 + y, w) for x, y, w in links(3, 10, 0.8, 0.02, 1)]
    got = {r.node: (r.community, r.size) for r in K.communities(spark.createDataFrame(rows, "a long, b long, weight double")).collect()}
    assert {got[100 + k] for k in range(10)} == {(0, 10)} and {c for c, _ in got.values()} == {0, 1, 2}
    assert K.communities(spark.createDataFrame([], "a long, b long, weight double")).count() == 0
    found = registry.queries()["r14_modularity"](spark, sf_dir).collect()
    spread = registry.queries()["r14_communities"](spark, sf_dir).collect()
    from loamline.operators import retrieval as R

    e = R.similarity_edges(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.3).collect()
    nodes = sorted({r.node for r in found})
    at = {n: k for k, n in enumerate(nodes)}
    a, b, w = np.array([at[r.a] for r in e]), np.array([at[r.b] for r in e]), np.array([r.weight for r in e])
    value = [K.modularity(a, b, w, np.array([c[n] for n in nodes])) for c in ({r.node: r.community for r in x} for x in (found, spread))]
    assert value[0] >= value[1] - 1e-9 and value[0] > 0


def test_layout_order():
    assert K.layout_order([0, 1, 2, 3, 4, 5], [(0, 1), (1, 2), (1, 3), (3, 2)]) == [1, 2, 3, 0, 5, 4]
    assert K.layout_order([], []) == []


def test_blobs(spark):
    df = spark.createDataFrame([(1, [0.5, -2.0]), (2, []), (3, None)], "id long, v array<float>")
    b = K.as_blobs(df, "id", "v")
    assert {r.id: r.blob and bytes(r.blob) for r in b.collect()} == {1: b"\x00\x00\x00\x3f\x00\x00\x00\xc0", 2: b"", 3: None}
    assert {r.id: r.vector for r in K.as_blobs(b, "id", "blob", back=True).collect()} == {1: [0.5, -2.0], 2: [], 3: None}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_cycles(spark, seed):
    """In one task and by rounds alike, against reachability."""
    rng = random.Random(seed)
    e = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)]
    reach = {v: {v} for v in range(40)}
    for _ in range(40):
        for a, b in e:
            for r in reach.values():
                if a in r:
                    r.add(b)
    want = {}
    for v in range(40):
        own = [u for u in range(40) if u in reach[v] and v in reach[u]]
        if len(own) > 1:
            want[v] = (min(own), len(own))
    df = spark.createDataFrame(e, "src long, dst long")
    for local in (1 << 20, 0) if seed == 0 else (1 << 20,):
        assert {r.node: (r.component, r.size) for r in G.scc(df, local=local).collect()} == want


def test_expand_over_hops(spark):
    n = spark.createDataFrame([(f"f.py::{x}", "f.py", x, None, "Function", x.startswith("test")) for x in ("a", "b", "c", "d", "test_a")], "qualified_name string, file_path string, name string, parent_name string, kind string, is_test boolean")
    e = spark.createDataFrame([("CALLS", f"f.py::{x}", "f.py", f"f.py::{y}") for x, y in (("a", "b"), ("b", "c"), ("c", "d"), ("test_a", "a"))], "kind string, source_qualified string, file_path string, target_qualified string")
    got = {r.node[6:]: (r.hops, r.via) for r in G.expand_calls(n, e, spark.createDataFrame([("f.py::a",)], "node string"), 3).collect()}
    assert got == {"b": (1, ["callee"]), "test_a": (1, ["caller", "test"]), "c": (2, ["callee"]), "d": (3, ["callee"])}


@pytest.mark.parametrize(
    "layers, imports, want",
    [
        (["controller", "model", "utility"], [], ("mvc", 0.75)),
        (["controller", "service", "repository", "model"], [(1, 0)], ("layered", 0.8)),
        (["controller", "service", "repository", "model"], [(0, 1)], ("clean", 0.85)),
        (["controller", "service"], [], ("layered", 0.7)),
        (["utility"] * 21, [], ("monolith", 0.6)),
        (["utility"] * 5, [], ("monolith", 0.5)),
        (["utility"] * 9, [], ("unknown", 0.3)),
        ([], [], ("monolith", 0.5)),
    ],
)
def test_architecture(spark, layers, imports, want):
    m = spark.createDataFrame(list(enumerate(layers)), "path long, layer string")
    assert tuple(K.architecture(m, spark.createDataFrame(imports, "src long, dst long")).first()) == want


def test_quiet_logs(spark):
    from loamline.operators import logs

    text = ["\x1b[32mstart\x1b[0m", "same", "same", "same", " 42%", "same", "last", "last"]
    df = spark.createDataFrame([("a", k, x) for k, x in enumerate(text)] + [("b", k, f"line {k}") for k in range(200)] + [("c", k, ("INFO x", "WARN y", "no level")[k % 3] + str(k)) for k in range(9)], "file string, line long, content string")
    got = {}
    for r in logs.quiet(df).orderBy("file", "position").collect():
        got.setdefault(r.file, []).append((r.position, r.content))
    assert [c for _, c in got["a"]] == ["start", "same (×4)", "last (×2)"]
    assert [p for p, _ in got["b"]] == list(range(1, 52)) and got["b"][20][1] == "... [150 lines omitted] ..." and got["b"][19][1] == "line 19" and got["b"][21][1] == "line 170"
    assert [c for _, c in got["c"]] == ["WARN y1", "no level2", "WARN y4", "no level5", "WARN y7", "no level8"]
    assert {(r.file, r.lines_original, r.lines_filtered) for r in logs.savings(df, logs.quiet(df)).collect()} == {("a", 8, 3), ("b", 200, 51), ("c", 9, 6)}
    assert logs.quiet(df.limit(0)).count() == 0


def test_impact_over_calls_alone(spark):
    """A thousand nodes, 20 000 imports between them and a chain of calls: imports are not followed."""
    imports = [("IMPORTS_FROM", f"f{i}", f"f{(i * 7 + j * 13) % 1000}") for i in range(1000) for j in range(20)]
    calls = [("CALLS", f"f{i}", f"f{i + 1}") for i in range(0, 10)]
    e = spark.createDataFrame(imports + calls, "kind string, source_qualified string, target_qualified string")
    n = spark.createDataFrame([(f"f{i}",) for i in range(1000)], "qualified_name string")
    seed = spark.createDataFrame([("f5",)], "node string")
    got = {r.node: (r.min_depth, r.truncated) for r in G.impact_radius(e, seed, 2, 500, nodes=n).collect()}
    assert got == {"f5": (0, False), "f4": (1, False), "f6": (1, False), "f3": (2, False), "f7": (2, False)}
    wide = G.impact_radius(e, seed, 2, 50, kind=None)
    assert wide.count() == 50 and {r.truncated for r in wide.collect()} == {True}


def test_dead_candidates(spark):
    names = [
        ("called", "a.rs", None, "rust", "fn called()", "", False),
        ("gone", "a.rs", None, "rust", "fn gone()", "", False),
        ("shown", "a.rs", None, "rust", "  pub fn shown()", "", False),
        ("tool", "a.rs", None, "rust", "fn tool()", "#[tool(x)]", False),
        ("Args1", "a.rs", None, "rust", "struct Args1", "#[derive(Debug, Args)]", False),
        ("Plain", "a.rs", None, "rust", "struct Plain", "#[derive(Debug)]", False),
        ("fmt", "a.rs", "T", "rust", "fn fmt()", "", False),
        ("main", "a.rs", None, "rust", "fn main()", "", False),
        ("method", "a.rs", "T", "rust", "fn method()", "", False),
        ("helper", "tests/h.rs", None, "rust", "fn helper()", "", False),
        ("checked", "a.rs", None, "rust", "fn checked()", "", True),
        ("cli", "src/bin/x.rs", None, "rust", "fn cli()", "", False),
        ("step", "build.rs", None, "rust", "fn step()", "", False),
        ("route", "web\\r.rs", None, "rust", "fn route()", "", False),
        ("Upper", "g.go", None, "go", "func Upper()", "", False),
        ("lower", "g.go", None, "go", "func lower()", "", False),
        ("_own", "d.dart", None, "dart", "void _own()", "", False),
        ("made", "m.ts", None, "typescript", "export function made()", "", False),
        ("any", "p.py", None, "python", None, None, False),
    ]
    rows = [(f"{f}::{p + '::' if p else ''}{n}", f, n, p, "Class" if n in ("Args1", "Plain") else "Function", t, lang, d, a, k) for k, (n, f, p, lang, d, a, t) in enumerate(names)]
    n = spark.createDataFrame(rows, "qualified_name string, file_path string, name string, parent_name string, kind string, is_test boolean, language string, decl string, above string, line_start int")
    e = spark.createDataFrame([("CALLS", "x", "called"), ("CALLS", "x", "T::method"), ("IMPORTS_FROM", "x", "gone")], "kind string, source_qualified string, target_qualified string")
    contracts = spark.createDataFrame([("web/r.rs",)], "file_path string")
    dead = K.dead_candidates(n, e, contracts)
    got = {r.name: r.confidence for r in dead.collect()}
    assert got == {"gone": "high", "shown": "medium", "Plain": "high", "Upper": "medium", "lower": "high", "_own": "high", "made": "medium", "any": "medium"}
    top = K.dead_report(dead, 3).collect()
    assert [r.name for r in top] == ["gone", "Plain", "_own"] and {r.total_found for r in top} == {8}
