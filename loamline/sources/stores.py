"""Stores that live on: tables opened with the columns of today, caches by hash, registries, keyed objects."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loamline.plans.lineage import cut


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def open_table(spark: SparkSession, path: str, schema: str, fill: dict[str, object] | None = None) -> DataFrame:
    """A stored table with the columns of `schema`: columns that older files don't have are null or `fill`'s value; no store, no rows."""
    want = StructType.fromDDL(schema)
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], want)
    got = spark.read.option("mergeSchema", True).parquet(path)
    fill = fill or {}
    cols = []
    for f in want.fields:
        col = F.col(f"`{f.name}`").cast(f.dataType) if f.name in got.columns else F.lit(None).cast(f.dataType)
        cols.append((F.coalesce(col, F.lit(fill[f.name]).cast(f.dataType)) if f.name in fill else col).alias(f.name))
    return got.select(*cols)


CHUNKS = "chunk_id long, file_path string, chunk int, line_start int, line_end int, text string, digest string, position long"
NODES = "qualified_name string, kind string, name string, file_path string, line_start int, line_end int, parent_name string, is_test boolean, language string"
EDGES = "kind string, source_qualified string, target_qualified string, file_path string, line int"
SAVINGS = "timestamp string, project string, operation string, original long, filtered long, savings_pct double"


def open_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk store; digests that older files lack are those of the text."""
    got = open_table(spark, path, CHUNKS)
    return got.withColumn("digest", F.coalesce("digest", F.sha2("text", 256)))


def open_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return open_table(spark, f"{path}/nodes", NODES, {"is_test": False}), open_table(spark, f"{path}/edges", EDGES)


def open_savings(spark: SparkSession, path: str) -> DataFrame:
    return open_table(spark, path, SAVINGS, {"original": 0, "filtered": 0, "savings_pct": 0.0})


def chunk_order(chunks: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(chunk_id, position): places from 0 in order of file and chunk, in two levels: within hash ranges of files, and over the ranges' counts.

    Positions are those of the order of (file range, file, chunk): stable for the same chunks, however they are stored.
    """
    keyed = chunks.select("chunk_id", "file_path", "chunk", F.pmod(F.xxhash64("file_path"), F.lit(width)).alias("_r"))
    counts = keyed.groupBy("_r").agg(F.count("*").alias("_n"))
    # As many rows as ranges, whatever the number of chunks.
    before = counts.select("_r", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    rn = F.row_number().over(Window.partitionBy("_r").orderBy("file_path", "chunk", "chunk_id"))
    return keyed.withColumn("_i", rn).join(before, "_r").select("chunk_id", (F.col("_b") + F.col("_i") - 1).alias("position"))


def save_communities(members: DataFrame, path: str) -> None:
    """Rewrites (chunk_id, community), with each community's size."""
    size = F.count("*").over(Window.partitionBy("community"))
    members.select("chunk_id", "community").withColumn("size", size).write.mode("overwrite").parquet(path)


def folder_bytes(spark: SparkSession, path: str) -> int:
    p, fs = _path(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def delete_index(spark: SparkSession, path: str) -> bool:
    """Whether there was one to delete."""
    p, fs = _path(spark, path)
    return bool(fs.delete(p, True))


def cached(spark: SparkSession, files: DataFrame, path: str, schema: str, make) -> DataFrame:
    """Rows of `make` over files (path, text), kept by the hash of the text: only new texts are made, the store is rewritten with what is current.

    `make` takes files and returns rows with `path` first; `schema` is theirs.
    """
    now = files.select("path", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_digest"))
    held = open_table(spark, path, f"_digest string, _seen boolean, {schema}")
    fresh = now.join(held.select("path", "_digest").distinct(), ["path", "_digest"], "left_anti")
    made = cut(make(fresh.select("path", "text")).join(fresh.select("path", "_digest"), "path").withColumn("_seen", F.lit(True)))
    # A file without rows is remembered too, by one row that is nothing but its hash.
    none = fresh.select("path", "_digest").join(made.select("path").distinct(), "path", "left_anti").withColumn("_seen", F.lit(False))
    kept = held.join(now.select("path", "_digest"), ["path", "_digest"], "left_semi")
    both = kept.unionByName(made.select(*kept.columns)).unionByName(none, allowMissingColumns=True)
    p, fs = _path(spark, path)
    both.write.mode("overwrite").parquet(path + ".new")
    fs.delete(p, True)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(path + ".new"), p)
    return open_table(spark, path, f"_digest string, _seen boolean, {schema}").filter("_seen").drop("_digest", "_seen")


def objects(specs: DataFrame, stored: DataFrame) -> DataFrame:
    """Each asked spec once with its content, null where there is none; stored: (spec, content)."""
    return specs.select("spec").distinct().join(stored.select("spec", "content"), "spec", "left")


PROJECTS = "project string, path string, kind string, description string, service string, command string, service_dir string, port int"


def registry(spark: SparkSession, text: str) -> DataFrame:
    """A registry's TOML as rows, one a service (a project without any has one row with nulls).  The driver reads it: it is a settings file."""
    rows = []
    for p in tomllib.loads(text).get("projects", []):
        head = (p.get("name"), p.get("path"), p.get("project_type"), p.get("description"))
        rows += [(*head, s.get("name"), s.get("command"), s.get("working_dir"), s.get("port")) for s in p.get("services", [])] or [(*head, None, None, None, None)]
    return spark.createDataFrame(rows, PROJECTS)


def registry_text(rows: DataFrame) -> str:
    """The TOML again, projects and services by name: `registry(registry_text(x))` is x."""
    quote = lambda x: '"' + str(x).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    out, last = [], None
    for r in rows.orderBy("project", "path", "service").collect():
        if (r["project"], r["path"]) != last:
            last = (r["project"], r["path"])
            out.append("[[projects]]")
            out += [f"{k} = {quote(r[c])}" for k, c in (("name", "project"), ("path", "path"), ("project_type", "kind"), ("description", "description")) if r[c] is not None]
        if r["service"] is not None:
            out.append("[[projects.services]]")
            out += [f"{k} = {quote(r[c])}" for k, c in (("name", "service"), ("command", "command"), ("working_dir", "service_dir")) if r[c] is not None]
            out += [f"port = {r['port']}"] if r["port"] is not None else []
    return "\n".join(out) + "\n"
