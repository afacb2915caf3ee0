"""Lexical and vector retrieval, and their fusion.

A query's terms are few, so BM25 needs no postings of all words: one scan counts
each term and the length of each document, which is written (a few numbers a
document); one aggregate of those gives the corpus statistics, and the top k are
taken without a full sort.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.plans.lineage import cut

TOKEN = r"[\p{L}\p{N}_]+"
K1, B, RRF_K = 1.2, 0.75, 60.0


def query_terms(query: str) -> list[str]:
    """Terms of a free query: runs of letters, digits and underscores of two and more; of an identifier query the first alone."""
    terms = [t.lower() for t in re.findall(r"\w+", query) if len(t) > 1]
    return terms[:1] if is_identifier(query) else terms


def is_identifier(query: str) -> bool:
    """A quoted query, or one word with an underscore or a capital after a small letter."""
    q = query.strip()
    if len(q) > 1 and q[0] == q[-1] and q[0] in "\"'`":
        return True
    return not re.search(r"\s", q) and ("_" in q or (q != q.lower() and q != q.upper() and not q.istitle()))


def identifier_flag(token: Column) -> Column:
    """As `is_identifier`, of a column of single tokens: an underscore, or a capital after a small letter's like."""
    rest = F.substr(token, F.lit(2))
    return token.contains("_") | ((token != F.lower(token)) & (token != F.upper(token)) & (rest != F.lower(rest)))


def query_allowed(query: str, mode: str = "hybrid") -> bool:
    """Two words at least, unless the query is an identifier or the mode is lexical."""
    return len(query.split()) > 1 or is_identifier(query) or search_mode(mode) == "lexical"


def search_mode(mode: str | None) -> str:
    return {"vector": "vector", "semantic": "vector", "lexical": "lexical", "bm25": "lexical", "text": "lexical"}.get((mode or "").lower(), "hybrid")


def _accents() -> tuple[str, str]:
    """Letters with marks of the Latin blocks, and the letters without, by their canonical decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and all(unicodedata.combining(x) for x in b[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTS = _accents()


def folded(text: Column) -> Column:
    """Small letters without marks."""
    return F.lower(F.translate(text, *ACCENTS))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(f"({TOKEN})"), F.lit(1))


def occurrences(text: Column, term: str) -> Column:
    """How often a text of small letters has a term between what is no part of terms; no array of all terms is made."""
    inside = r"[\p{L}\p{N}_]"
    return F.when(text.contains(term), F.regexp_count(text, F.lit(rf"(?<!{inside})\Q{term}\E(?!{inside})"))).otherwise(0)


def bm25(docs: DataFrame, terms: list[str], id_col: str, text_col: str, k: int | None = None) -> DataFrame:
    """(id, score), higher is better.  A term in over half the documents keeps a small positive weight."""
    low = docs.select(F.col(id_col).alias("id"), folded(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    counted = low.select("id", F.regexp_count("t", F.lit(TOKEN)).alias("dl"), *[occurrences(F.col("t"), term).alias(f"tf{i}") for i, term in enumerate(terms)])
    counted = cut(counted)
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        tf = F.col(f"tf{i}").cast("double")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hit = " or ".join(f"tf{i} > 0" for i in range(len(terms)))
    # The statistics are one row.
    out = counted.filter(hit).join(F.broadcast(stats)).select("id", F.round(score, 6).alias("score"))
    return out.orderBy(F.desc("score"), "id").limit(k) if k else out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a vector has no direction."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def knn(vectors: DataFrame, query: list[float], id_col: str, vector_col: str, k: int) -> DataFrame:
    """The k nearest by cosine, exactly: one scan and a bounded heap a task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    out = vectors.select(F.col(id_col).alias("id"), F.round(cosine(F.col(vector_col), q), 6).alias("score"))
    return out.orderBy(F.desc("score"), "id").limit(k)


def overfetch(k: int) -> int:
    return max(3 * k, 10)


def ranked(top: DataFrame) -> DataFrame:
    """Ranks from 1 of a top list: as many rows as were asked for, so one task will do."""
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))


def rrf(lists: list[tuple[DataFrame, float]], k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of top lists (id, score) with weights."""
    parts = None
    for top, weight in lists:
        own = ranked(top).select("id", (F.lit(weight) / (RRF_K + F.col("rank"))).alias("w"))
        parts = own if parts is None else parts.unionByName(own)
    out = parts.groupBy("id").agg(F.round(F.sum("w"), 6).alias("score")).orderBy(F.desc("score"), "id")
    return out.limit(k) if k else out


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], k: int, mode: str = "hybrid", id_col: str = "doc_id", text_col: str = "text", vec_id: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Search by mode: (id, score, cosine, text).  Fusion orders; the cosine is reported, 0 where there is no vector."""
    mode, fetch = search_mode(mode), overfetch(k)
    lists = []
    if mode != "lexical":
        lists.append((knn(vectors, query_vector, vec_id, vector_col, fetch), 1.0))
    terms = query_terms(query)
    if mode != "vector" and terms:
        lists.append((bm25(docs, terms, id_col, text_col, fetch), 2.0 if is_identifier(query) else 1.0))
    if not lists:
        raise ValueError("the query has no terms")
    fused = rrf(lists, k)
    q = F.array(*[F.lit(float(x)) for x in query_vector]) if mode != "lexical" else None
    cos = vectors.select(F.col(vec_id).alias("id"), (F.round(cosine(F.col(vector_col), q), 6) if q is not None else F.lit(0.0)).alias("cosine"))
    return fused.join(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id").join(cos, "id", "left").select("id", "score", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), "text")


def hydrate(fused: DataFrame, docs: DataFrame, vectors: DataFrame, communities: DataFrame, query_vector: list[float]) -> DataFrame:
    """Fused ids (id, score) with what stands behind them: their rows of docs (id, ..), their community (id, community; null without one) and their cosine to the query (id, vector; 0 without a vector).

    Ids that are no document go.
    """
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    cos = vectors.select("id", F.round(cosine(F.col("vector"), q), 6).alias("cosine"))
    return fused.join(docs, "id").join(communities.select("id", "community"), "id", "left").join(cos, "id", "left").fillna(0.0, ["cosine"])


def row_index(df: DataFrame, id_col: str, width: int = 1 << 16) -> DataFrame:
    """Adds `idx`, each row's place from 0 in order of an integer id, in two levels: within id ranges, and over the ranges' counts."""
    part = F.floor(F.col(id_col) / width)
    keyed = df.withColumn("_range", part)
    counts = keyed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(id_col))
    return keyed.withColumn("_i", inside).join(before, "_range").withColumn("idx", F.col("_before") + F.col("_i") - 1).drop("_range", "_i", "_before")


def similarity_edges(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 500) -> DataFrame:
    """(a, b, weight) of an evenly spaced sample of at most `most` vectors whose cosine exceeds a threshold.

    The sample is this operator's purpose: every n-th vector, so that the theta join is of a fixed size.
    """
    n = vectors.count()
    step = max(1, n // most)
    s = row_index(vectors.filter(F.col(vector_col).isNotNull()).select(id_col, vector_col), id_col).filter((F.col("idx") % step == 0) & (F.col("idx") / step < most))
    s = s.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.sqrt(dot(F.col(vector_col), F.col(vector_col))).alias("n"))
    a, b = s.select(F.col("id").alias("a"), F.col("v").alias("va"), F.col("n").alias("na")), s.select(F.col("id").alias("b"), F.col("v").alias("vb"), F.col("n").alias("nb"))
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.when((F.col("na") > 0) & (F.col("nb") > 0), dot(F.col("va"), F.col("vb")) / (F.col("na") * F.col("nb"))).otherwise(0.0).alias("weight"))
    return pairs.filter(F.col("weight") > threshold).select("a", "b", F.round("weight", 6).alias("weight"))


def fuzzy_search(names: DataFrame, needle: str, name_col: str, qualified_col: str, limit: int, ties: list[str] | None = None) -> DataFrame:
    """Names that are, end with or contain a needle, without regard to case but for equality; `%` and `_` are wildcards."""
    name, qn, pattern = F.col(name_col), F.col(qualified_col), f"%{needle.lower()}%"
    rank = F.when(name == needle, 0).when(F.lower(qn).like(f"%::{needle.lower()}"), 1).otherwise(2)
    out = names.filter((name == needle) | F.lower(name).like(pattern) | F.lower(qn).like(pattern)).withColumn("rank", rank)
    return out.orderBy("rank", F.length(qn), qn, *(ties or [])).limit(limit)


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: ** is anything (and takes a slash after it), * anything but slashes."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            i += pattern.startswith("/", i)
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def by_globs(df: DataFrame, text: Column, globs: list[str], keep: bool = True) -> DataFrame:
    """Rows that match any glob, or none."""
    hit = F.lit(False)
    for g in globs:
        hit = hit | text.rlike(glob_regex(g))
    return df.filter(hit if keep else ~hit)


def token_savings(docs: DataFrame, text_col: str, group: str) -> DataFrame:
    """A text's tokens are estimated as a quarter of its bytes, rounded down for each row."""
    return docs.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.floor(F.octet_length(text_col) / 4)).alias("tokens"), F.sum(F.octet_length(text_col)).alias("bytes"))


# Declarations by which symbols are found, one family a pattern.
SYMBOL_PATTERNS = (
    r"(?m)\b(?:fn|struct|impl|class|def|defp|defmodule|defprotocol|defimpl|defmacro|defmacrop|func|interface|trait|enum)\s+([A-Za-z_][A-Za-z0-9_.?!]*)",
    r"(?m)\b(?:void|Future|Stream|Widget|List|Map|Set|String|int|double|bool|num|dynamic|Iterable|Iterator)(?:<[^>]+>)?\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    r"(?m)^\s*([a-z][A-Za-z0-9_]*)\s*\([^\)\n]*\)\s*->",
    r"(?m)\b(?:plug|pipeline|scope|resources|forward|live|get|post|put|delete|patch)\s+:?([A-Za-z_][A-Za-z0-9_]*)",
    r"(?m)^\s*(?:@\w+\s+)?(?:static\s+|final\s+)?[A-Z][A-Za-z0-9_]*(?:<[^>;{}]*>)?\??\s+(_?[a-z][A-Za-z0-9_]*)\s*\(",
    r"(?m)^\s*(?:factory\s+)?[A-Z][A-Za-z0-9_]*\.([a-z_][A-Za-z0-9_]*)\s*\(",
    r"(?m)\bfinal\s+([a-z_][A-Za-z0-9_]*)\s*=\s*(?:State(?:Notifier)?Provider|Notifier(?:Provider)?|AsyncNotifierProvider|ChangeNotifierProvider|FutureProvider|StreamProvider|Provider)\b",
)


def symbols(text: Column, patterns: tuple[str, ...] = SYMBOL_PATTERNS, most: int = 5) -> Column:
    """Distinct symbols of two letters and more that a text declares, in order of family, at most `most`."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]))
    return F.slice(F.array_distinct(F.filter(found, lambda x: F.length(x) >= 2)), 1, most)


def seed_score(s: Column) -> Column:
    return F.lit(0.6) * s + F.lit(0.4)


def structural_score(hops: Column) -> Column:
    return F.lit(0.4) / F.greatest(hops, F.lit(1))


def nearest_context(context: DataFrame, key: list[str], order: list[str], most: int = 20) -> DataFrame:
    """Of a structural context (key, hops, ..) each key once, by its fewest hops; the first `most` by hops and then by `order`."""
    best = context.groupBy(*key).agg(F.min("hops").alias("hops"), *[F.min(c).alias(c) for c in order if c not in key])
    return best.orderBy("hops", *order).limit(most)


def merge_ranked(seeds: DataFrame, context: DataFrame, key: list[str]) -> DataFrame:
    """Seeds (key, s) and context (key, hops) as one list: the seed's score wins where both have a key."""
    both = seeds.select(*key, F.round(seed_score(F.col("s")), 6).alias("score"), F.lit(0).alias("origin"), F.lit(0).alias("hops")).unionByName(
        context.select(*key, F.round(structural_score(F.col("hops")), 6).alias("score"), F.lit(1).alias("origin"), F.col("hops").cast("int").alias("hops"))
    )
    first = both.groupBy(*key).agg(F.min(F.struct("origin", "hops", (-F.col("score")).alias("neg"))).alias("m"))
    return first.select(*key, (-F.col("m.neg")).alias("score"), F.when(F.col("m.origin") == 0, "semantic").otherwise("structural").alias("origin"), F.col("m.hops").alias("hops"))
