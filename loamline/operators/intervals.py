"""Range joins.  Each carries an equality (the file), so that none becomes a product of both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(spans: DataFrame, ranges: DataFrame, key: str, s0: str, s1: str, r0: str, r1: str) -> DataFrame:
    """Pairs of one key whose closed intervals meet."""
    return spans.join(ranges, (spans[key] == ranges[key]) & (spans[s0] <= ranges[r1]) & (spans[s1] >= ranges[r0])).drop(ranges[key])


def hunks_to_symbols(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """Changed symbols of hunks (file, start, end, status) over nodes (file, symbol, line_start, line_end).

    A hunk in no symbol is a row of its file (symbol null); a file without nodes is new; deleted files have no rows.
    """
    h = hunks.filter("status <> 'deleted'").select("file", F.col("start").alias("h0"), F.col("end").alias("h1"))
    hit = overlap_join(nodes, h, "file", "line_start", "line_end", "h0", "h1").select("file", "symbol", "h0", "h1")
    loose = h.join(hit.select("file", "h0", "h1").distinct(), ["file", "h0", "h1"], "left_anti").select("file").distinct()
    known = nodes.select("file").distinct().withColumn("known", F.lit(True))
    loose = loose.join(known, "file", "left").select("file", F.lit(None).cast("string").alias("symbol"), F.col("known").isNull().alias("is_new_file"))
    return hit.select("file", "symbol").distinct().withColumn("is_new_file", F.lit(False)).unionByName(loose)


def near_ranges(findings: DataFrame, ranges: DataFrame, key: str, line: str, r0: str, r1: str, margin: int = 3) -> DataFrame:
    """Findings within `margin` lines of a range of their file, and those of a changed file as a whole (line null)."""
    r = ranges.select(F.col(key).alias("_k"), F.col(r0).alias("_0"), F.col(r1).alias("_1"))
    at = (F.col(line).isNull()) | F.col(line).between(F.col("_0") - margin, F.col("_1") + margin)
    return findings.join(r, (findings[key] == F.col("_k")) & at, "left_semi")


def tightest_span(points: DataFrame, spans: DataFrame, key: str, line: str, s0: str, s1: str, name: str) -> DataFrame:
    """Each point (key, line) with the shortest span around it; the least name of equals."""
    s = spans.select(F.col(key).alias("_k"), F.col(s0).alias("_0"), F.col(s1).alias("_1"), F.col(name).alias("_n"))
    hit = points.join(s, (points[key] == F.col("_k")) & F.col(line).between(F.col("_0"), F.col("_1")))
    return hit.groupBy(*points.columns).agg(F.min(F.struct((F.col("_1") - F.col("_0")).alias("len"), F.col("_n").alias("name"))).alias("m")).select(*points.columns, F.col("m.name").alias(name))


def nearest_chunk(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """For nodes (file, symbol, line_start, line_end) the overlapping chunk (file, chunk_id, c0, c1) that begins nearest, else the file's first."""
    c = chunks.select("file", "chunk_id", "c0", "c1")
    hit = nodes.join(c, "file").filter("c0 <= line_end and c1 >= line_start")
    best = hit.groupBy("file", "symbol", "line_start", "line_end").agg(F.min(F.struct(F.abs(F.col("c0") - F.col("line_start")).alias("d"), "chunk_id")).alias("m"))
    first = chunks.groupBy("file").agg(F.min(F.struct("c0", "chunk_id")).alias("f"))
    out = nodes.join(best, ["file", "symbol", "line_start", "line_end"], "left").join(first, "file", "left")
    return out.select("file", "symbol", "line_start", "line_end", F.coalesce(F.col("m.chunk_id"), F.col("f.chunk_id")).alias("chunk_id"), F.col("m").isNotNull().alias("overlaps"))


def islands(rows: DataFrame, part: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbouring values: (part, island, value, n)."""
    w = Window.partitionBy(*part).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = rows.withColumn("_c", change).withColumn("island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*part, "island").agg(F.first(value).alias(value), F.count("*").alias("n"))


def collapsed_label(value: Column, n: Column) -> Column:
    return F.when(n > 1, F.concat(value, F.lit(" (×"), n.cast("string"), F.lit(")"))).otherwise(value)


def head_tail(rows: DataFrame, part: list[str], order: list[str], head: int = 20, tail: int = 30, above: int = 150) -> DataFrame:
    """All rows of small groups; of groups of more than `above` rows the first and last ones.  Adds `rn` and `omitted`."""
    w = Window.partitionBy(*part)
    n = F.count("*").over(w)
    rn = F.row_number().over(w.orderBy(*order))
    out = rows.withColumn("n_rows", n).withColumn("rn", rn).filter((F.col("n_rows") <= above) | (F.col("rn") <= head) | (F.col("rn") > F.col("n_rows") - tail))
    return out.withColumn("omitted", F.when(F.col("n_rows") > above, F.col("n_rows") - head - tail).otherwise(0)).drop("n_rows")


def last_n(rows: DataFrame, part: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each group; order: latest first."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col("rn") <= n)


def transitions(rows: DataFrame, part: str, order: list[str], value: str) -> DataFrame:
    """Rows at which a value differs from the one before, with that one (null at first)."""
    w = Window.partitionBy(part).orderBy(*order)
    prev = rows.withColumn("previous", F.lag(value).over(w)).withColumn("_i", F.row_number().over(w))
    return prev.filter((F.col("_i") == 1) | ~F.col("previous").eqNullSafe(F.col(value))).drop("_i")


def sessions(rows: DataFrame, part: str, ts: str, order: list[str], gap_seconds: float) -> DataFrame:
    """(part, session, start, end, n): runs of rows no more than a gap apart."""
    w = Window.partitionBy(part).orderBy(ts, *order)
    gap = F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(w))
    new = F.when(gap.isNull() | (gap > int(gap_seconds * 1_000_000)), 1).otherwise(0)
    marked = rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(part, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))


def context(lines: DataFrame, part: str, order: str, text: str, before: int = 3, after: int = 3) -> DataFrame:
    """Adds `around`: each line with its neighbours, joined by line ends."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(-before, after)
    return lines.withColumn("around", F.array_join(F.collect_list(text).over(w), "\n"))


def forward_fill(lines: DataFrame, part: str, order: str, value: Column, name: str) -> DataFrame:
    """The last value that isn't null up to each row."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(w))


def next_value(rows: DataFrame, ts: str, tie: str, value: str, name: str, unit: str = "day") -> DataFrame:
    """Each row's next value in order of time over the whole table, in two levels: within a day, and from a day's end to the next day's first row."""
    keyed = rows.withColumn("_d", F.date_trunc(unit, F.col(ts)))
    inside = Window.partitionBy("_d").orderBy(ts, tie)
    firsts = keyed.groupBy("_d").agg(F.min_by(value, F.struct(ts, tie)).alias("_first"))
    # One row a day, whatever the number of rows.
    up = firsts.select("_d", F.lead("_first").over(Window.orderBy("_d")).alias("_up"))
    last = F.row_number().over(Window.partitionBy("_d").orderBy(F.desc(ts), F.desc(tie))) == 1
    out = keyed.withColumn("_n", F.lead(value).over(inside)).withColumn("_l", last).join(up, "_d", "left")
    return out.withColumn(name, F.when(F.col("_l"), F.col("_up")).otherwise(F.col("_n"))).drop("_d", "_n", "_l", "_up")
