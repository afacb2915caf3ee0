"""Aggregates: savings, layers, anti-patterns, snapshots, risk and quality scores, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities from the gravest, and what a finding of a severity adds to the risk by its confidence.
SEVERITIES = ("critical", "high", "medium", "low", "info")
RISK = {"critical": (20, 15, 10), "high": (10, 7, 4), "medium": (3, 2, 1), "low": (0, 0, 0), "info": (0, 0, 0)}
CONFIDENCES = ("certain", "probable", "heuristic")
IMPORTANCE = {"important": 5.0, "warning": 2.0, "suggestion": 0.5}


def recent(events: DataFrame, ts: str, as_of: str, days: int, project: str | None = None, value: str | None = None) -> DataFrame:
    """Rows of the last days before a stated time; of one project, if named."""
    out = events.filter(F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days"))
    return out.filter(F.col(project) == value) if project and value is not None else out


def savings(events: DataFrame, original: Column, filtered: Column, pct: Column, group: str | None = None) -> DataFrame:
    """Operations, average percentage and lines saved, in all or by a group; zeros where there are no rows."""
    aggs = [F.count("*").alias("operations"), F.round(F.coalesce(F.avg(pct), F.lit(0.0)), 6).alias("avg_pct"), F.round(F.coalesce(F.sum(original - filtered), F.lit(0.0)), 4).alias("lines_saved")]
    return events.groupBy(group).agg(*aggs) if group else events.agg(*aggs)


def dashboard(lines: Column) -> list[Column]:
    """Tokens and cost of lines saved: eight tokens a line, three dollars a million."""
    return [(lines * 8).alias("tokens"), F.round(lines * 8 * 3 / 1_000_000, 6).alias("cost")]


def distribution(rows: DataFrame, key: str, weight: Column) -> DataFrame:
    """Rows, weight and share of all rows by key."""
    g = rows.groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum(weight), 4).alias("weight"))
    total = rows.agg(F.count("*").alias("_all"))
    return g.join(F.broadcast(total)).select(key, "n", "weight", F.round(100.0 * F.col("n") / F.col("_all"), 6).alias("pct"))


#: Lines and functions from which a module is too large, medium and high, by language.
GOD_CLASS = {"dart": (800, 1500, 25, 40), "rust": (600, 1200, 20, 35), "": (500, 1000, 15, 25)}


def antipatterns(modules: DataFrame, imports: DataFrame, cycles: DataFrame) -> DataFrame:
    """(path, kind, severity) of modules (path, language, layer, loc, function_count, is_hub, has_macros, fan_out).

    imports: (src, dst) between modules; cycles: (node) in cycles.  Tests and hubs are never god classes, and functions
    of modules made by macros don't count; a project of over five modules with controllers needs services.
    """

    def limit(i: int) -> Column:
        out = F.lit(GOD_CLASS[""][i])
        for lang, t in GOD_CLASS.items():
            out = F.when(F.col("language") == lang, t[i]).otherwise(out) if lang else out
        return out

    def rule(rows: DataFrame, kind: str, severe: Column) -> DataFrame:
        return rows.select("path", F.lit(kind).alias("kind"), F.when(severe, "high").otherwise("medium").alias("severity"))

    many = lambda i: ~F.col("has_macros") & (F.col("function_count") > limit(i))
    god = rule(modules.filter((F.col("layer") != "test") & ~F.col("is_hub") & ((F.col("loc") > limit(0)) | many(2))), "god_class", (F.col("loc") > limit(1)) | many(3))
    fat = rule(modules.filter("layer = 'controller' and loc > 200"), "fat_controller", F.col("loc") > 400)
    skips = layer_violations(modules, imports, [("controller", "repository")]).select(F.col("src").alias("path"), F.lit("fat_controller").alias("kind"), F.lit("medium").alias("severity"))
    wide = rule(modules.filter("fan_out > 10"), "excessive_coupling", F.col("fan_out") > 20)
    round_ = cycles.select(F.col("node").alias("path"), F.lit("circular_dependency").alias("kind"), F.lit("high").alias("severity"))
    shape = modules.agg(F.count("*").alias("n"), F.max((F.col("layer") == "service").cast("int")).alias("services"))
    bare = modules.filter("layer = 'controller'").join(F.broadcast(shape.filter("n > 5 and services = 0"))).select("path", F.lit("no_service_layer").alias("kind"), F.lit("medium").alias("severity"))
    return god.unionByName(fat).unionByName(skips).unionByName(wide).unionByName(round_).unionByName(bare)


def layer_violations(modules: DataFrame, imports: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(src, dst) of imports from one layer straight to another that it should not know."""
    a = modules.select(F.col("path").alias("src"), F.col("layer").alias("from_layer"))
    b = modules.select(F.col("path").alias("dst"), F.col("layer").alias("to_layer"))
    bad = F.lit(False)
    for x, y in pairs:
        bad = bad | ((F.col("from_layer") == x) & (F.col("to_layer") == y))
    return imports.join(a, "src").join(b, "dst").filter(bad).select("src", "dst", "from_layer", "to_layer").distinct()


def severity_summary(findings: DataFrame, severity: str = "severity") -> DataFrame:
    """One row: findings of each severity."""
    return findings.agg(*[F.coalesce(F.sum((F.col(severity) == s).cast("long")), F.lit(0)).alias(s) for s in SEVERITIES])


def risk_score(findings: DataFrame, severity: str = "severity", confidence: str = "confidence") -> DataFrame:
    """One row: the findings' weights in sum, 100 at most."""
    w = F.lit(0)
    for s, by in RISK.items():
        for c, v in zip(CONFIDENCES, by, strict=True):
            w = F.when((F.col(severity) == s) & (F.col(confidence) == c), v).otherwise(w)
    return findings.agg(F.least(F.lit(100), F.coalesce(F.sum(w), F.lit(0))).cast("long").alias("risk"))


def quality_score(findings: DataFrame, tools: DataFrame, tool: str = "tool", severity: str = "severity") -> DataFrame:
    """(tool, score): 100 less what findings weigh, 0 at least; tools without findings keep 100."""
    w = F.lit(0.0)
    for s, v in IMPORTANCE.items():
        w = F.when(F.col(severity) == s, v).otherwise(w)
    lost = findings.groupBy(tool).agg(F.sum(w).alias("_lost"))
    return tools.join(lost, tool, "left").select(tool, F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce("_lost", F.lit(0.0))).alias("score"))


def compare_snapshots(rows: DataFrame, key: str, ts: str, measures: list[str]) -> DataFrame:
    """Each snapshot with the change of its measures since its key's one before (null at the first)."""
    w = Window.partitionBy(key).orderBy(ts)
    return rows.select(key, ts, *measures, *[F.round(F.col(m) - F.lag(m).over(w), 4).alias(f"d_{m}") for m in measures])


def trend(d_anti: Column, d_cc: Column, d_god: Column, d_cycle: Column, d_cov: Column) -> Column:
    """The debt trend of changes: worse or better beyond a band of one."""
    score = 2 * d_anti + d_cc + 3 * d_god + 3 * d_cycle - F.lit(0.5) * d_cov
    return F.when(score > 1, "degrading").when(score < -1, "improving").otherwise("stable")


def percent(part: Column, whole: Column) -> Column:
    """0 where there is nothing to have a part of."""
    return F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0))


def dominant(rows: DataFrame, key: str, value: str, weight: Column, share: float = 0.5) -> DataFrame:
    """(key, value, share): the value with at least a share of its key's weight; the least of equals."""
    g = rows.groupBy(key, value).agg(F.sum(weight).alias("w"))
    best = g.groupBy(key).agg(F.max("w").alias("w"), F.sum("w").alias("all"))
    out = g.join(best, [key, "w"]).groupBy(key).agg(F.min(value).alias(value), F.max(F.col("w") / F.col("all")).alias("share"))
    return out.filter(F.col("share") >= share).withColumn("share", F.round("share", 6))


def period(ts: Column, unit: str) -> Column:
    """A timestamp's day, ISO week, month or year as text."""
    if unit == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    return F.date_format(ts, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[unit])


def timeline(commits: DataFrame, tasks: DataFrame, unit: str) -> DataFrame:
    """(period, commits, tasks) newest first: ids of a period's commits (id, ts) and of the tasks (id, ts) whose last move was in it, in order."""
    ids = lambda df, name: df.groupBy(period(F.col("ts"), unit).alias("period")).agg(F.sort_array(F.collect_list("id")).alias(name))
    both = ids(commits, "commits").join(ids(tasks, "tasks"), "period", "full_outer")
    none = F.array().cast("array<long>")
    return both.select("period", F.coalesce("commits", none).alias("commits"), F.coalesce("tasks", none).alias("tasks")).orderBy(F.desc("period"))


def hot_spots(findings_per_file: DataFrame, complexity: DataFrame, patterns: DataFrame) -> DataFrame:
    """(file, symbol, reason, severity): files with over 3 findings, functions of complexity 30 and more, grave anti-patterns; one row a place, the gravest."""
    a = findings_per_file.filter("n > 3").select("file", F.lit("").alias("symbol"), F.lit("findings").alias("reason"), F.lit("medium").alias("severity"))
    b = complexity.filter("complexity >= 30").select("file", F.col("name").alias("symbol"), F.lit("complexity").alias("reason"), F.when(F.col("complexity") > 40, "high").otherwise("medium").alias("severity"))
    c = patterns.filter("severity = 'high'").select(F.col("path").alias("file"), F.lit("").alias("symbol"), F.lit("antipattern").alias("reason"), F.col("severity"))
    order = F.when(F.col("severity") == "high", 0).otherwise(1)
    both = a.unionByName(b).unionByName(c)
    return both.groupBy("file", "symbol").agg(F.min(F.struct(order.alias("o"), "reason", "severity")).alias("m")).select("file", "symbol", "m.reason", "m.severity")
