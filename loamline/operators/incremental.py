"""State tables: what changed, what is stale, what has to be made again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(now: DataFrame, state: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): added, changed, unchanged or gone, by a content digest."""
    a = now.select(key, F.col(digest).alias("_new"))
    b = state.select(key, F.col(digest).alias("_old"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "gone").when(F.col("_new") == F.col("_old"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def skip(force: bool, rows: DataFrame) -> DataFrame:
    """Adds `skip` to rows (git_unchanged, indexed, hash, stored_hash, mtime, stored_mtime): unchanged for git and indexed, else by hash, else by time."""
    by_hash = F.col("hash") == F.col("stored_hash")
    by_time = F.col("mtime") <= F.col("stored_mtime")
    s = F.when(F.lit(force), False).when(F.col("git_unchanged") & F.col("indexed"), True).when(F.col("hash").isNotNull() & F.col("stored_hash").isNotNull(), by_hash).otherwise(F.coalesce(by_time, F.lit(False)))
    return rows.withColumn("skip", s)


def dependents(imports: DataFrame, changed: DataFrame, src: str = "src", dst: str = "dst", key: str = "path") -> DataFrame:
    """Modules that import a changed one and are not changed themselves."""
    hit = imports.join(changed.select(F.col(key).alias(dst)), dst, "left_semi").select(F.col(src).alias(key)).distinct()
    return hit.join(changed.select(key), key, "left_anti")


def replace_files(stored: DataFrame, new: DataFrame, files: DataFrame, key: str = "file_path") -> DataFrame:
    """Stored rows of other files, and the new rows."""
    return stored.join(files.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows, and the stored rows of keys that have no new one."""
    return stored.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def sync(markers: DataFrame, tasks: DataFrame, key: str = "hash") -> DataFrame:
    """(key, action): insert what is new, leave what is on both sides, resolve what is gone; a key counts once."""
    m = markers.select(key).distinct().withColumn("_m", F.lit(True))
    t = tasks.select(key).distinct().withColumn("_t", F.lit(True))
    return m.join(t, key, "full_outer").select(key, F.when(F.col("_t").isNull(), "insert").when(F.col("_m").isNull(), "resolve").otherwise("unchanged").alias("action"))
