"""Calls are resolved by files, without broadcasts of nodes and without joining all callers of a name with all its definitions."""

from __future__ import annotations

import glob
import hashlib
import os
import time

import pytest
from pyspark.sql import functions as F

from loamline.operators import graph as G
from loamline.operators import lookups as K
from loamline.plans.lineage import cut

NODE = "qualified_name string, file_path string, name string, parent_name string, kind string, is_test boolean"
EDGE = "kind string, source_qualified string, file_path string, target_qualified string"


def node(file, name, parent=None):
    return ("::".join(x for x in (file, parent, name) if x), file, name, parent, "Function", False)


def graph(spark):
    n = [node("a/x.py", "f", "T"), node("a/x.py", "g"), node("b/y_z.py", "f"), node("b/w.py", "h"), node("c/v.py", "k"), ("loose", "d/l.py", "loose", None, "Function", False)]
    e = [
        ("CALLS", "a/x.py::g", "a/x.py", "f"),
        ("CALLS", "a/x.py::g", "a/x.py", "T::f"),
        ("CALLS", "a/x.py::g", "a/x.py", "a/x.py::T::f"),
        ("CALLS", "c/v.py::k", "c/v.py", "f"),
        ("CALLS", "c/v.py::k", None, "h"),
        ("CALLS", "c/v.py::k", "c/v.py", "loose"),
        ("IMPORTS_FROM", "c/v.py", "c/v.py", "pkg.yXz"),
    ]
    return spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE)


def pairs(df, a, b):
    return sorted((r[a], r[b]) for r in df.select(a, b).collect())


def test_a_pair_found_in_several_ways_comes_once(spark):
    n, e = graph(spark)
    want = [("a/x.py::T::f", "a/x.py::g"), ("b/w.py::h", "c/v.py::k"), ("b/y_z.py::f", "c/v.py::k"), ("loose", "c/v.py::k")]
    assert pairs(G.callers(n, e), "target", "caller") == want
    assert pairs(G.callers_typed(n, e), "target", "caller") == [want[0], want[3]]
    assert pairs(G.callees(n, e), "caller", "target") == [("a/x.py::g", "a/x.py::T::f"), ("c/v.py::k", "loose")]
    assert pairs(G.callers(n, e, of=spark.createDataFrame([("b/w.py::h",)], "node string"), few=True), "target", "caller") == [want[1]]


@pytest.mark.parametrize("run", [G.callers, G.callees, G.callers_typed, K.low_confidence_callees, lambda n, e: G.callers(n, e, low_confidence=True)])
def test_nodes_are_not_broadcast(spark, run):
    n, e = graph(spark)
    plan = run(n, e.filter("kind = 'CALLS'"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "BroadcastHashJoin" not in plan.replace("BroadcastHashJoin [c_file", "")


def test_all_nodes_that_an_undecided_call_can_mean_are_rows(spark):
    n = [node("c/v.py", "k"), *(node(f"m{i % 2}/f{i}.py", name) for i in range(15) for name in ("f", "g"))]
    e = [("CALLS", "c/v.py::k", "c/v.py", "f"), ("CALLS", "c/v.py::k", "c/v.py", "g")]
    got = K.low_confidence_callees(spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE)).collect()
    assert sorted(r.target for r in got) == sorted(x[0] for x in n[1:]) and {(r.caller, r.confidence) for r in got} == {("c/v.py::k", "low")}


def hub(spark):
    """Functions that all call T::f and g, which are defined in many files."""
    h = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(200)]
    n = [(*node(f"{x}/{x}.py", "f", "T")[:4], kind, False) for x in h for kind in ("Function", "Class")] + [node(f"{x}/{x}.py", "g") for x in h]
    e = [("CALLS", f"c/v.py::{x[::-1]}", "c/v.py", t) for x in h for t in ("T::f", "g")]
    return spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE)


@pytest.mark.parametrize(("run", "rows"), [(G.callers, 40000), (G.callees, 40000), (K.low_confidence_callees, 80000)])
def test_pairs_are_not_shuffled(spark, run, rows):
    n, e = hub(spark)
    written = lambda: spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    assert run(n, e).count() == rows
    assert written() - before < 1 << 20


def test_a_table_that_is_cut_leaves_no_shuffle_behind(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    held = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = held()
    table = cut(spark.range(200000).select((F.col("id") * 7).alias("id")).groupBy("id").count())
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before
    assert table.count() == 200000
