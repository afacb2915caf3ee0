"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamline.llm import simhash

    return simhash.dedup(_documents(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamline.llm import quality

    return quality.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamline.llm import suffix_dedup

    return suffix_dedup.dedup(_documents(spark, sf_dir))


def op4_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamline.llm import piece_lattice

    return piece_lattice.encode(_documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamline.llm import token_counts

    return token_counts.count_documents(_documents(spark, sf_dir))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamline.llm import flat_graph

    return flat_graph.near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamline.llm import substring_dedup

    return substring_dedup.dedup(_documents(spark, sf_dir))


def op8_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamline.llm import media

    return media.digest(_documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamline.llm import packing

    return packing.pack(_documents(spark, sf_dir))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamline.llm import ngram_lm

    return ngram_lm.score(_documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


#: Words, their windows, the windows that start in a document before, and the words that none of those covers.
SUBSTRING_SQL = r"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, p, array_to_string(ws[p:p + 12], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as p from w where len(ws) >= 13)),
m as (select k, min(doc_id) as first from g group by k),
c as (select distinct doc_id, unnest(range(p, p + 13)) as i from (select g.doc_id, g.p from g join m using (k) where m.first < g.doc_id)),
x as (select w.doc_id, ws[i] as word, i from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from w) w),
kept as (select x.doc_id, string_agg(word, ' ' order by x.i) as t, count(*) as n from x left join c on c.doc_id = x.doc_id and c.i = x.i where c.i is null group by x.doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept on kept.doc_id = w.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query and is quick enough over whole tables."""
    return {"op7_substring_dedup": SUBSTRING_SQL}
