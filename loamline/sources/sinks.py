"""Writers: whole tables replaced by rename, rows appended, keys set, results as JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.operators import incremental


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Writes beside the old table and renames: readers see the old or the new one, and a table may be made from itself."""
    spark, beside = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(beside)
    fs, p = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    if fs.exists(p):
        fs.delete(p, True)
    fs.rename(jvm.org.apache.hadoop.fs.Path(beside), p)


def store_files(new: DataFrame, files: DataFrame, path: str, key: str = "file_path") -> None:
    """The rows of these files, in place of those the table has of them."""
    spark = new.sparkSession
    old = spark.read.parquet(path) if exists(spark, path) else new.limit(0)
    replace_table(incremental.replace_files(old, new, files, key), path)


def set_values(values: dict[str, str], spark: SparkSession, path: str) -> None:
    """Keys with values, in place of those that the table has."""
    new = spark.createDataFrame(list(values.items()), "key string, value string")
    old = spark.read.parquet(path) if exists(spark, path) else new.limit(0)
    replace_table(incremental.upsert(old, new, ["key"]), path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def record_saving(spark: SparkSession, path: str, ts: str, project: str, operation: str, original: int, filtered: int) -> None:
    pct = 100.0 * (original - filtered) / original if original > 0 else 0.0
    row = spark.createDataFrame([(ts, project, operation, original, filtered, pct)], "ts string, project string, operation string, lines_original long, lines_filtered long, savings_pct double")
    append(row.withColumn("ts", F.to_timestamp("ts")), path)


def as_json(df: DataFrame) -> DataFrame:
    """(value): each row as JSON."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
