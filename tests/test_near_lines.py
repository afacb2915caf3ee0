"""Only lines with a word of a rule become rows; they are all that the rules can meet."""

from __future__ import annotations

from loamline.operators import audit as A
from loamline.plans import rules

TEXTS = [
    "x = 1\nAPI_KEY = 'abcdefgh1'\n\nplain words here",
    "",
    None,
    "eval(x)\neval(y)\n",
    "ünïcode ß API-KEY: \"0123456789\"\r\nos.system('a')\n\n\nLicensed Under CC BY-NC",
    "no line of this one\nmeets any",
    "\n\nhost 0.0.0.0 and 0x0y0z0",
    "İ PASSWORD = 'dotted'\nKelvin toKen = 'abcdefgh1'",
]


def test_same_findings(spark):
    df = spark.createDataFrame(list(enumerate([*TEXTS, *TEXTS * 100])), "doc_id long, text string").coalesce(1)
    rows = lambda x: sorted(map(tuple, x.collect()))
    every = A.lines(df, "doc_id", "text")
    near = A.near_lines(df, "doc_id", "text", rules.RULES)
    assert rows(A.findings(near, rules.RULES)) == rows(A.findings(every, rules.RULES)) != []
    assert set(rows(near)) <= set(rows(every)) and near.filter("content like '%meets any%' or content like '%0x0y%' and content not like '%0.0.0.0%'").isEmpty()
    # A rule without words may meet any line.
    free = (*rules.RULES, A.Rule("any", "Any", "info", "^$"))
    assert rows(A.findings(A.near_lines(df, "doc_id", "text", free), free)) == rows(A.findings(every, free))


def test_queries_do_not_make_rows_of_all_lines(spark, sf_dir):
    for q in (rules.a18s, rules.a18, rules.a17, rules.audit_findings):
        plan = q(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "posexplode" not in plan
