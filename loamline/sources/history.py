"""Version-control text: logs, diffs, changed files, commit details."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD, FIELD = "\x1e", "\x1f"
CONVENTIONAL = r"^([a-z]+)(?:\(([^)]*)\))?!?:\s*(.*)$"
RESOLVES = r"(?i)(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s+#?([A-Za-z]*-?\d+)"


def work_log(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """(commit, date, author, ctype, scope, subject, resolves) of a log whose records end in 0x1e and whose fields are parted by 0x1f."""
    raw = spark.read.option("lineSep", RECORD).text(path).select(F.split(F.trim(F.regexp_replace("value", r"^\s+", "")), FIELD).alias("f")).filter(F.size("f") >= 4)
    out = raw.select(F.get("f", 0).alias("commit"), F.get("f", 1).alias("date"), F.get("f", 2).alias("author"), F.get("f", 3).alias("line"), F.coalesce(F.get("f", 4), F.lit("")).alias("body"))
    out = out.filter(F.col("date") >= since) if since else out
    kind = F.regexp_extract("line", CONVENTIONAL, 1)
    return out.select(
        "commit", "date", "author", F.when(kind != "", kind).otherwise("other").alias("ctype"), F.nullif(F.regexp_extract("line", CONVENTIONAL, 2), F.lit("")).alias("scope"),
        F.when(kind != "", F.regexp_extract("line", CONVENTIONAL, 3)).otherwise(F.col("line")).alias("subject"),
        F.array_distinct(F.regexp_extract_all(F.concat_ws("\n", "line", "body"), F.lit(RESOLVES), F.lit(1))).alias("resolves"),
    )


def parse_diff(path: str, text: str) -> Iterator[tuple]:
    """(diff, file, old_file, status, start, end, added, removed) for each hunk of a diff without context; a file without hunks has one row without a range."""
    for part in re.split(r"(?m)^diff --git ", text)[1:]:
        head = re.match(r"a/(.*?) b/(.*)", part)
        old, new = head.groups() if head else ("", "")
        status = "added" if re.search(r"(?m)^new file mode", part) else "deleted" if re.search(r"(?m)^deleted file mode", part) else "renamed" if re.search(r"(?m)^rename from", part) else "modified"
        hunks = list(re.finditer(r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@.*$", part))
        if not hunks:
            yield path, new, old, status, None, None, 0, 0
        for k, h in enumerate(hunks):
            body = part[h.end() : hunks[k + 1].start() if k + 1 < len(hunks) else len(part)].split("\n")
            start, n = int(h[3]), int(h[4] if h[4] is not None else 1)
            yield path, new, old, status, max(1, start), max(1, start) + max(0, n - 1), sum(x.startswith("+") for x in body), sum(x.startswith("-") for x in body)


DIFF = "diff string, file string, old_file string, status string, start int, end int, added int, removed int"


def diffs(files: DataFrame) -> DataFrame:
    from loamline.sources.files import rows_of

    return rows_of(files, parse_diff, DIFF)


def changed_files(name_only: DataFrame, porcelain: DataFrame) -> DataFrame:
    """(path) of a list of names and of a status listing, where a rename counts as its target."""
    a = name_only.select(F.trim("value").alias("path"))
    b = porcelain.select(F.regexp_replace(F.substring("value", 4, 1 << 20), r"^.* -> ", "").alias("path"))
    return a.unionByName(b).filter("path <> ''").distinct()


def numstat(lines: DataFrame) -> DataFrame:
    """(file, added, removed, binary) of lines of added, removed and file; binary files count as -1."""
    p = F.split("value", "\t")
    n = lambda i: F.when(F.get(p, i) == "-", -1).otherwise(F.get(p, i).cast("int"))
    return lines.filter(F.size(p) == 3).select(F.get(p, 2).alias("file"), n(0).alias("added"), n(1).alias("removed"), (F.get(p, 0) == "-").alias("binary"))


def commit_totals(stats: DataFrame) -> DataFrame:
    pos = lambda c: F.coalesce(F.sum(F.when(F.col(c) >= 0, F.col(c))), F.lit(0))
    return stats.agg(F.count("*").alias("files"), pos("added").alias("added"), pos("removed").alias("removed"))


def commit_type(paths: DataFrame) -> DataFrame:
    """One row: the type that the shape of a diff suggests; paths: (path, status)."""
    p = F.col("path")
    doc, test = p.rlike(r"\.(md|rst|txt|adoc)$"), p.rlike(r"(^|/)(tests?|spec)/|(^|/)test_|_test\.|\.(test|spec)\.")
    conf, asset = p.rlike(r"\.(toml|ya?ml|json|ini|cfg|lock)$|(^|/)Dockerfile$"), p.rlike(r"\.(png|jpe?g|svg|gif|ico|css|woff2?)$")
    every = lambda c: F.bool_and(c)
    return paths.agg(F.when(every(doc), "docs").when(every(test), "test").when(every(conf), "chore").when(every(asset), "style").when(F.bool_or(F.col("status") == "added"), "feat").otherwise("fix").alias("ctype"))


def lowercase_first(s: Column) -> Column:
    return F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 20))
