"""Anti-patterns read line items for pairs and modules once; distinct rows are dealt to as many tasks as they want."""

from __future__ import annotations

from loamline.plans import lines_and_time as L


def test_line_items_are_not_read_again(spark, sf_dir):
    plan = L.a14(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # Of all rows only the keys, written once, are left; the tables' own columns would name a scan.
    assert "l_orderkey" not in plan and "s_nationkey" not in plan


def test_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "DEALT", 50)
    df = spark.range(2000).selectExpr("id % 40 as a", "id % 500 as b").unionByName(spark.createDataFrame([(1, None), (1, None)], "a long, b long"))
    got = L.dealt(df, 2000, "a", "b")
    held = got.rdd.mapPartitions(lambda x: [sum(r["n"] for r in x)]).collect()
    assert len(held) == 41 and max(held) < 200
    rows = {(r.a, r.b): r.n for r in got.collect()}
    assert rows.pop((1, None)) == 2 and set(rows.values()) == {2} and len(rows) == 1000
