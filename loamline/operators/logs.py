"""Logs with less noise: a file's lines in order, without colours, progress, repeats, low levels and middles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.operators.audit import is_progress, strip_ansi
from loamline.operators.code_audit import any_of
from loamline.operators.intervals import collapsed_label

# Words that are levels, and those that keep a line; lines kept at both ends of what is longer, and a saving worth a row.
LEVELS, GRAVE = ("INFO", "WARN", "ERROR", "DEBUG", "TRACE"), ("WARN", "ERROR", "FATAL", "PANIC")
HEAD, TAIL, ABOVE = 20, 30, 150
WORTH = 10.0


def is_low(text: Column) -> Column:
    """Whether a line has a level and none that matters."""
    up = F.upper(text)
    return any_of(up, LEVELS) & ~any_of(up, GRAVE)


def quiet(lines: DataFrame, compact: bool = True, head: int = HEAD, tail: int = TAIL, above: int = ABOVE) -> DataFrame:
    """(file, position, content) of lines (file, line, content), positions from 1 without gaps.

    Runs of equal lines are one with their number; `compact` drops lines of low levels in files of which a fifth of the
    lines has levels; of more than `above` lines the middle is one line that says how many went.
    """
    s = lines.select("file", "line", strip_ansi(F.col("content")).alias("content")).filter(~is_progress(F.col("content")))
    w = Window.partitionBy("file").orderBy("line")
    new = F.coalesce((F.lag("content").over(w) != F.col("content")).cast("int"), F.lit(1))
    runs = s.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("file", "_run").agg(F.min("line").alias("line"), F.first("content").alias("content"), F.count("*").alias("n"))
    runs = runs.withColumn("content", collapsed_label(F.col("content"), F.col("n")))
    if compact:
        has = any_of(F.upper("content"), LEVELS).cast("int")
        per = Window.partitionBy("file")
        levelled = runs.withColumn("_l", F.sum(has).over(per)).withColumn("_n", F.count("*").over(per))
        runs = levelled.filter(~((F.col("_l") > 0) & (F.col("_l") * 5 >= F.col("_n")) & is_low(F.col("content"))))
    rn, n = F.row_number().over(w), F.count("*").over(Window.partitionBy("file"))
    kept = runs.select("file", "line", "content", rn.alias("rn"), n.alias("n"))
    long = F.col("n") > above
    kept = kept.filter(~long | (F.col("rn") <= head + 1) | (F.col("rn") > F.col("n") - tail))
    gap = F.concat(F.lit("... ["), (F.col("n") - head - tail).cast("string"), F.lit(" lines omitted] ..."))
    content = F.when(long & (F.col("rn") == head + 1), gap).otherwise(F.col("content"))
    position = F.when(long & (F.col("rn") > head + 1), F.col("rn") - F.col("n") + head + 1 + tail).otherwise(F.col("rn"))
    return kept.select("file", position.cast("long").alias("position"), content.alias("content"))


def savings(lines: DataFrame, filtered: DataFrame) -> DataFrame:
    """(file, lines_original, lines_filtered, savings_pct) of files whose log went down by more than a tenth."""
    a = lines.groupBy("file").agg(F.count("*").alias("lines_original"))
    b = filtered.groupBy("file").agg(F.count("*").alias("lines_filtered"))
    pct = F.round(F.greatest(F.lit(0.0), (1 - F.col("lines_filtered") / F.col("lines_original")) * 100), 4)
    return a.join(b, "file", "left").fillna(0, ["lines_filtered"]).withColumn("savings_pct", pct).filter(F.col("savings_pct") > WORTH)
