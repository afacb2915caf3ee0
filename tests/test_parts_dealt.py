"""Files that are written out from a few bytes of numbers are dealt to as many tasks as their texts want."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from loamline.plans import code


@pytest.fixture
def tables(spark, tmp_path):
    rows = 3 * code.PARTS
    part = spark.range(rows).selectExpr("id as p_partkey", "cast(1 + id % 7 as int) as p_size", "'b' as p_brand")
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(9).selectExpr("id as s_suppkey", "cast(id - 4 as double) as s_acctbal").write.parquet(str(tmp_path / "supplier.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["a21_complexity", "j04_call_edges", "r08_symbols", "a25_hot_spots", "r01_chunks_of_functions"])
def test_one_small_file_is_not_one_task(spark, tables, name):
    plan = entry.queries()[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    below = plan.split("REPARTITION_BY_NUM", 1)[1]
    assert "regexp_extract_all" not in below.split("Scan parquet", 1)[0]


@pytest.mark.parametrize("make", [code.files, code.functions, code.module_files])
def test_dealt_evenly(spark, tables, make):
    sizes = make(spark, tables).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 4 and max(sizes) < 2 * code.PARTS
