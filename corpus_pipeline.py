"""The corpus pipeline: documents of quality, one of each group of near copies, without repeated passages, packed.

Each stage takes the rows that the one before it kept, written as Parquet and
read again, and all but the last return the columns of documents.

Defined results: documents with a null id are never near copies of others; null
texts stay null up to packing, where they are empty; rows that repeat an id are
one document and stay or go together; columns beyond those of documents stay;
an empty table packs into no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import packing, quality, simhash, suffix_dedup
from loamline.llm.store import Scratch
from loamline.plans.ship import ship

#: Near copies: by shingles of five words, this similar or more.
SIMILARITY, WORDS = 0.8, 5
#: SQL has no discriminant analysis, fingerprints, suffix arrays or packing; tests hold each stage against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    keep = Scratch(spark, "simhash-stage")
    groups = simhash.dedup_similar(docs, SIMILARITY, WORDS)
    gone = keep.save(groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes of strings of 100 that start earlier; n_chars is that of the new text."""
    out = suffix_dedup.rewrite(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in as few sequences as best-fit gives."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("simhash", simhash_stage), ("suffix", suffix_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written before the next."""
    ship(spark)
    keep = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
