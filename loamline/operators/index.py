"""The chunk index: what has to be made again, chunks with their context, and the store's statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.operators import incremental
from loamline.sources import code


def stale(files: DataFrame, stored: DataFrame, imports: DataFrame) -> DataFrame:
    """(path): files whose digest differs from the stored one or that have none, and the files that import them."""
    now = files.select("path", F.sha2("text", 256).alias("digest"))
    changed = incremental.changes(now, stored, "path", "digest").filter("status in ('added', 'changed')").select("path")
    return changed.unionByName(incremental.dependents(imports, changed)).distinct()


def refresh(files: DataFrame, stored_chunks: DataFrame, stored: DataFrame, imports: DataFrame) -> DataFrame:
    """The chunks of all present files: made again where stale, kept where not, gone where the file is."""
    redo = stale(files, stored, imports)
    fresh = code.chunks(files.join(redo, "path", "left_semi"))
    kept = stored_chunks.join(files.select("path"), "path", "left_semi").join(redo, "path", "left_anti")
    return kept.select(fresh.columns).unionByName(fresh)


def with_context(chunks: DataFrame, importers: DataFrame, imports: DataFrame, most: int = 3) -> DataFrame:
    """Adds `embedding_text`: the chunk after up to three of the files that use it and of the names it imports."""
    names = lambda df, key, value: df.groupBy(F.col(key).alias("path")).agg(F.slice(F.array_sort(F.collect_set(value)), 1, most).alias("n"))
    used, needs = names(importers, "dst", "src").withColumnRenamed("n", "used"), names(imports, "path", "name").withColumnRenamed("n", "needs")
    line = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"// {label}: "), F.array_join(c, ", "), F.lit("\n"))).otherwise("")
    both = chunks.join(used, "path", "left").join(needs, "path", "left")
    text = F.concat(F.coalesce(line("Used by", "used"), F.lit("")), F.coalesce(line("Imports", "needs"), F.lit("")), "text")
    return both.withColumn("embedding_text", text).drop("used", "needs")


def statistics(chunks: DataFrame) -> DataFrame:
    """One row: files, chunks, lines (the last line of each file) and lines returned at forty a chunk."""
    per = chunks.groupBy("path").agg(F.max("line_end").alias("loc"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("loc"), F.lit(0)).alias("lines"), F.coalesce(F.sum("n") * 40, F.lit(0)).alias("lines_in_chunks"))
