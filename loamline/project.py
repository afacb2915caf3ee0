"""A source tree as tables, and the questions one asks of it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.operators import audit, code_audit, contracts, graph, index, intervals, lookups, metrics, retrieval
from loamline.plans.ship import ship
from loamline.sources import code, coverage, documents, files, history


class Project:
    """The tables of a project are made when first asked for and read once."""

    def __init__(self, spark: SparkSession, root: str, ignore: list[str] | None = None):
        ship(spark)
        self.spark, self.root, self.ignore = spark, root, ignore or []

    @cached_property
    def files(self) -> DataFrame:
        return files.scan(self.spark, self.root, ignore=self.ignore)

    @cached_property
    def chunks(self) -> DataFrame:
        return code.chunks(files.indexable(self.spark, self.root, self.ignore)).withColumn("chunk_id", F.xxhash64("path", "chunk"))

    @cached_property
    def call_graph(self) -> tuple[DataFrame, DataFrame]:
        n, e = code.call_graph(self.files)
        return n.cache(), e.cache()

    @cached_property
    def lines(self) -> DataFrame:
        return audit.lines(self.files.filter("language is not null"), "path", "text")

    @cached_property
    def modules(self) -> DataFrame:
        return code.modules(self.files.filter("language is not null"))

    @cached_property
    def findings(self) -> DataFrame:
        settings = files.hidden(self.spark, self.root, ".*").unionByName(self.files.select("path", "text"))
        found = audit.findings(self.lines, audit.SECRET_RULES).unionByName(code_audit.line_findings(self.files))
        return found.unionByName(code_audit.error_findings(self.files)).unionByName(code_audit.config_findings(settings))

    def search(self, query: str, k: int = 10) -> DataFrame:
        """Chunks by BM25 of their text and path."""
        terms = retrieval.query_terms(query)
        if not terms or not retrieval.query_allowed(query, "lexical"):
            raise ValueError("the query has no terms")
        c = self.chunks.withColumn("doc", F.concat_ws(" ", "text", "path"))
        top = retrieval.bm25(c, terms, "chunk_id", "doc", k)
        return top.join(self.chunks.select(F.col("chunk_id").alias("id"), "path", "line_start", "line_end", "text"), "id").orderBy(F.desc("score"), "id")

    def impact(self, changed: list[str] | DataFrame, depth: int = 2, most: int = 500, only_calls: bool = True) -> DataFrame:
        """What changed files (paths, or rows with a column `file`) reach and are reached from, over calls resolved to their targets."""
        n, e = self.call_graph
        rows = changed.select(F.col("file").alias("file_path")).distinct() if isinstance(changed, DataFrame) else self.spark.createDataFrame([(x,) for x in changed], "file_path string")
        seeds = n.join(rows, "file_path", "left_semi").select(F.col("qualified_name").alias("node"))
        calls = graph.callees(n, e).select(F.lit("CALLS").alias("kind"), F.col("caller").alias("source_qualified"), F.col("target").alias("target_qualified"))
        e = calls.unionByName(e.filter("kind <> 'CALLS'").select(calls.columns))
        return graph.impact_radius(e, seeds, depth, most, "CALLS" if only_calls else None, n)

    def query_graph(self, what: str, name: str, limit: int = 50) -> DataFrame:
        """callers or callees of a qualified name, tests that call it, or nodes by a needle."""
        n, e = self.call_graph
        if what == "search":
            return retrieval.fuzzy_search(n, name, "name", "qualified_name", limit).select("qualified_name", "kind", "file_path", "line_start")
        if what == "callees":
            return graph.callees(n, e).filter(F.col("caller") == name).select(F.col("target").alias("qualified_name"))
        got = graph.callers(n, e).filter(F.col("target") == name).select(F.col("caller").alias("qualified_name"))
        if what == "tests":
            return got.join(n.filter("is_test").select("qualified_name"), "qualified_name", "left_semi")
        if what == "callers":
            return got
        raise ValueError(f"{what} is none of callers, callees, tests, search")

    def dead_code(self) -> DataFrame:
        """Uncalled functions and classes; uncertain where the name stands elsewhere in the text."""
        n, e = self.call_graph
        dead = graph.dead_nodes(n, e)
        words = self.files.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_]+)"), F.lit(1))).alias("name")).groupBy("name").agg(F.count("*").alias("uses"))
        return dead.join(words, "name", "left").select("qualified_name", "kind", "file_path", "line_start", F.when(F.col("uses") > 1, "uncertain").otherwise("dead").alias("confidence"))

    def tests_for(self, changed: DataFrame) -> DataFrame:
        """Tests that reach changed functions (function), most covering first."""
        n, e = self.call_graph
        calls = graph.callees(n, e).select(F.col("caller").alias("src"), F.col("target").alias("dst"))
        cov = graph.coverage_map(calls, n.filter("is_test and kind <> 'File'").select(F.col("qualified_name").alias("test")))
        return graph.suggest_tests(cov, changed).orderBy(F.desc("covers"), "hops", "test")

    def review(self, diff: DataFrame) -> dict[str, DataFrame]:
        """Of a diff (path, text): changed symbols, findings near the changes, what they reach, and totals."""
        hunks = history.diffs(diff).cache()
        n, _ = self.call_graph
        nodes = n.filter("kind <> 'File'").select(F.col("file_path").alias("file"), F.col("qualified_name").alias("symbol"), "line_start", "line_end")
        ranges = hunks.filter("start is not null")
        symbols = intervals.hunks_to_symbols(nodes, ranges)
        near = intervals.near_ranges(self.findings, ranges, "file", "line", "start", "end")
        totals = hunks.agg(F.countDistinct("file").alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
        return {"symbols": symbols, "findings": near, "impact": self.impact(hunks, 2, 200), "totals": totals}

    def env(self) -> DataFrame:
        """(key, status): variables read but not in any settings file, and those in one that nothing reads."""
        reads = files.env_reads(self.files).select("key")
        known = files.env_keys(files.hidden(self.spark, self.root, ".env*")).select("key").distinct()
        return lookups.env_drift(reads, known)

    def audit(self, suppress: list[tuple[str, str]] | None = None) -> DataFrame:
        """Findings that nothing silences, with severity and confidence where they stand."""
        kept = audit.suppress(self.findings, self.lines, suppress or [], F.col("file"))
        role = F.when(files.is_generated(F.col("file")), "generated").when(F.col("file").rlike(r"(?i)(^|/)(i18n|locales?|l10n)/"), "i18n").otherwise("core")
        sev, conf = audit.in_context(F.col("severity"), F.col("category"), role, files.is_test_path(F.col("file")), F.lit(False))
        return kept.withColumn("adjusted", sev).withColumn("confidence", conf)

    def risk(self) -> DataFrame:
        return metrics.risk_score(self.audit(), "adjusted", "confidence")

    def debt(self) -> DataFrame:
        return audit.explicit_debt(self.lines).orderBy("file", "line")

    def complexity(self, least: int = 10) -> DataFrame:
        """Functions of a complexity, with whether their file is covered (null where no report has it)."""
        c = code.complexity(self.files).filter(F.col("complexity") >= least)
        rep = coverage.first_report(coverage.reports(self.files)).select("file", (F.col("hit") > 0).alias("has_coverage"))
        return contracts.suffix_join(c, rep, "path", "file", ["has_coverage"])

    def routes(self) -> DataFrame:
        return documents.api_routes(self.files).withColumn("key", F.concat_ws(" ", "method", contracts.rest_path(F.col("route"))))

    def statistics(self) -> DataFrame:
        return index.statistics(self.chunks)
