"""Queries over the tables, first part: retrieval and the call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.operators import graph as G
from loamline.operators import retrieval as R
from loamline.plans.lineage import cut
from loamline.plans.registry import query

TOK = r"[\p{L}\p{N}_]+"
TERMS = ("the", "edon", "ouel")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def bm25_sql(terms: tuple[str, ...] = TERMS, limit: int | None = 20) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) as tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"sum((tf{i} > 0)::int) as df{i}" for i in range(len(terms)))
    one = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    hit = " or ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""with tk as (select doc_id as id, regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '{TOK}') as t from documents),
c as (select id, len(t) as dl, {tf} from tk), s as (select count(*) as n, avg(dl) as avgdl, {df} from c)
select id, round({one}, 6) as score from c, s where {hit} order by score desc, id""" + (f" limit {limit}" if limit else "")


@query("r02_bm25_topk", bm25_sql())
def r02(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(table(spark, d, "documents"), list(TERMS), "doc_id", "text", 20)


@query("f05_fuzzy_search", """select p_partkey, p_name, case when p_name = 'ring' then 0 when lower(p_type || '::' || p_name) like '%::ring' then 1 else 2 end as rank from part
where p_name = 'ring' or lower(p_name) like '%ring%' or lower(p_type || '::' || p_name) like '%ring%' order by rank, length(p_type || '::' || p_name), p_type || '::' || p_name, p_partkey limit 50""")
def f05(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("qn", F.concat_ws("::", "p_type", "p_name"))
    return R.fuzzy_search(p, "ring", "p_name", "qn", 50, ["p_partkey"]).select("p_partkey", "p_name", "rank")


GLOBS = ["*/en/**", "**/fr/*5"]


@query("f10_glob_filter", r"""select page_id, url from (select page_id, url, regexp_replace(url, '^https?://', '') as p from pages) where regexp_matches(p, '^[^/]*/en/.*$') or regexp_matches(p, '^.*fr/[^/]*5$')""")
def f10(spark: SparkSession, d: str) -> DataFrame:
    return R.by_globs(table(spark, d, "pages").select("page_id", "url"), F.regexp_replace("url", "^https?://", ""), GLOBS)


@query("r04_identifier_flag", rf"""select token, count(*) as n, (contains(token, '_') or (token <> lower(token) and token <> upper(token) and substr(token, 2) <> lower(substr(token, 2)))) as is_identifier
from (select unnest(regexp_extract_all(coalesce(text, ''), '{TOK}')) as token from documents) group by token""")
def r04(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({TOK})"), F.lit(1))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n")).withColumn("is_identifier", R.identifier_flag(F.col("token")))


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector that searches start from: that of the least id."""
    row = table(spark, d, "embeddings").filter("embedding is not null").orderBy("vec_id").select("embedding").first()
    return [float(x) for x in row[0]] if row else [1.0]


COS = "list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where embedding is not null order by vec_id limit 1))"


@query("a35_cosine_knn", f"select vec_id as id, round({COS}, 6) as score from embeddings order by score desc, id limit 10")
def a35(spark: SparkSession, d: str) -> DataFrame:
    return R.knn(table(spark, d, "embeddings"), query_vector(spark, d), "vec_id", "embedding", 10)


@query("j10_similarity_edges", """with r as (select vec_id, embedding::double[] as v, row_number() over (order by vec_id) - 1 as i, count(*) over () as n from embeddings where embedding is not null),
s as (select * from r where i % greatest(1, n // 500) = 0 and i / greatest(1, n // 500) < 500)
select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.v, b.v), 6) as weight from s a join s b on a.vec_id < b.vec_id where list_cosine_similarity(a.v, b.v) > 0.3""")
def j10(spark: SparkSession, d: str) -> DataFrame:
    return R.similarity_edges(table(spark, d, "embeddings"), 0.3)


RRF_SQL = f"""with b as (select id, row_number() over (order by score desc, id) as r from ({bm25_sql(limit=30)})),
v as (select id, row_number() over (order by score desc, id) as r from (select vec_id as id, round({COS}, 6) as score from embeddings order by score desc, id limit 30)),
u as (select id, 1.0 / (60 + r) as w from v union all select id, 2.0 / (60 + r) from b)"""


@query("w04_j13_rrf_hybrid", RRF_SQL + " select id, round(sum(w), 6) as score from u group by id order by score desc, id limit 10")
def w04(spark: SparkSession, d: str) -> DataFrame:
    lex = R.bm25(table(spark, d, "documents"), list(TERMS), "doc_id", "text", 30)
    vec = R.knn(table(spark, d, "embeddings"), query_vector(spark, d), "vec_id", "embedding", 30)
    return R.rrf([(vec, 1.0), (lex, 2.0)], 10)


@query("j14_hydrated_search", RRF_SQL + f""", t as (select id, round(sum(w), 6) as score from u group by id order by score desc, id limit 10)
select t.id, t.score, coalesce(round({COS}, 6), 0.0) as cosine, e.label as community, sha256(d.text) as text_sha from t join documents d on d.doc_id = t.id left join embeddings e on e.vec_id = t.id""")
def j14(spark: SparkSession, d: str) -> DataFrame:
    docs, vec = table(spark, d, "documents"), table(spark, d, "embeddings")
    q = query_vector(spark, d)
    top = R.rrf([(R.knn(vec, q, "vec_id", "embedding", 30), 1.0), (R.bm25(docs, list(TERMS), "doc_id", "text", 30), 2.0)], 10)
    texts = docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("text_sha"))
    own = vec.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("community"))
    return R.hydrate(top, texts, own, own, q).select("id", "score", "cosine", "community", "text_sha")


@query("a28_savings", "select source, count(*) as n, sum(octet_length(encode(coalesce(text, ''))) // 4)::bigint as tokens, sum(octet_length(encode(coalesce(text, ''))))::bigint as bytes from documents group by source")
def a28(spark: SparkSession, d: str) -> DataFrame:
    return R.token_savings(table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit(""))), "text", "source")


# --- The call graph that the graph queries run over: parts are functions, lineitems their calls.

NODES = """select case when p_size % 3 = 0 then 'm' || (p_partkey % 8)::varchar || '/f' || (p_partkey % 64)::varchar || '.py::' || p_type || '::' || nm
  else 'm' || (p_partkey % 8)::varchar || '/f' || (p_partkey % 64)::varchar || '.py::' || nm end as qualified_name,
 'm' || (p_partkey % 8)::varchar || '/f' || (p_partkey % 64)::varchar || '.py' as file_path, nm as name,
 case when p_size % 3 = 0 then p_type end as parent_name, case when p_size % 5 = 0 then 'Class' else 'Function' end as kind, (p_size % 7 = 0) as is_test, p_partkey
 from (select *, replace(p_name, ' ', '_') || '_' || (p_partkey % 37)::varchar as nm from part)"""
CALLS = f"""select distinct 'CALLS' as kind, a.qualified_name as source_qualified, a.file_path,
 case l_linenumber % 3 when 0 then b.qualified_name when 1 then coalesce(b.parent_name || '::', '') || b.name else b.name end as target_qualified
 from lineitem join n a on a.p_partkey = l_partkey join n b on b.p_partkey = (l_suppkey * 7 + l_linenumber) % (select count(*) from part)"""
CTE = f"with recursive n as ({NODES}), e as ({CALLS})"


def call_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the tables' call graph."""
    p = table(spark, d, "part").withColumn("name", F.concat(F.translate("p_name", " ", "_"), F.lit("_"), (F.col("p_partkey") % 37).cast("string")))
    file = F.concat(F.lit("m"), (F.col("p_partkey") % 8).cast("string"), F.lit("/f"), (F.col("p_partkey") % 64).cast("string"), F.lit(".py"))
    parent = F.when(F.col("p_size") % 3 == 0, F.col("p_type"))
    n = p.select(F.concat_ws("::", file, parent, F.col("name")).alias("qualified_name"), file.alias("file_path"), "name", parent.alias("parent_name"), F.when(F.col("p_size") % 5 == 0, "Class").otherwise("Function").alias("kind"), (F.col("p_size") % 7 == 0).alias("is_test"), "p_partkey")
    total = p.count()
    li = table(spark, d, "lineitem").select("l_partkey", "l_linenumber", ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % total).alias("k"))
    a = n.select(F.col("p_partkey").alias("l_partkey"), F.col("qualified_name").alias("source_qualified"), "file_path")
    b = n.select(F.col("p_partkey").alias("k"), F.col("qualified_name").alias("q"), F.col("name").alias("bn"), F.concat_ws("::", "parent_name", "name").alias("typed"))
    m = F.col("l_linenumber") % 3
    # No broadcasts: a part's numbers are small in their file, its names are not.  A caller's rows come together, for what follows.
    e = li.join(b.hint("merge"), "k").select("l_partkey", F.when(m == 0, F.col("q")).when(m == 1, F.col("typed")).otherwise(F.col("bn")).alias("target_qualified"))
    e = e.join(a.hint("merge"), "l_partkey").select(F.lit("CALLS").alias("kind"), "source_qualified", "file_path", "target_qualified").repartition("source_qualified").distinct()
    return n, e


@query("j01_impact_radius", """with recursive e as (select distinct 's' || l_suppkey::varchar as a, 'p' || l_partkey::varchar as b from lineitem), adj as (select a, b from e union all select b, a from e),
bfs(node, depth) as (select 's1', 0 union select adj.b, depth + 1 from bfs join adj on adj.a = bfs.node where depth < 2),
m as (select node, min(depth) as min_depth from bfs group by node), t as (select * from m order by min_depth, node limit 500)
select node, min_depth, (select count(*) >= 500 from t) as truncated from t""")
def j01(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    e = li.select(F.lit("CALLS").alias("kind"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_qualified"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target_qualified"))
    return G.impact_radius(e, spark.createDataFrame([("s1",)], "node string"), 2, 500)


@query("j02_callers_typed", CTE + """ select distinct n.qualified_name as target, e.source_qualified as caller from n join e on e.target_qualified = n.qualified_name or (n.parent_name is not null and e.target_qualified = n.parent_name || '::' || n.name)""")
def j02(spark: SparkSession, d: str) -> DataFrame:
    n, e = call_graph(spark, d)
    return G.callers_typed(n, e)


COMMON = ", ".join(f"'{x}'" for x in G.COMMON_NAMES)
PFX = "regexp_extract({}, '^(crates/[^/]+|[^/]*)', 1)"


@query("j03_callers_disambiguated", CTE + f""", df as (select name, count(distinct file_path) as files from n group by name), dm as (select name, {PFX.format('file_path')} as prefix, count(distinct file_path) as files_here from n group by 1, 2),
x as (select distinct n.qualified_name as target, e.source_qualified as caller from n join e on e.target_qualified = n.qualified_name or (n.parent_name is not null and e.target_qualified = n.parent_name || '::' || n.name)),
b as (select distinct n.qualified_name as target, e.source_qualified as caller from n join e on e.target_qualified = n.name join df on df.name = n.name join dm on dm.name = n.name and dm.prefix = {PFX.format('n.file_path')}
 where e.file_path = n.file_path or (n.name not in ({COMMON}) and (df.files = 1 or ({PFX.format('e.file_path')} = dm.prefix and dm.files_here = 1))))
select * from x union select * from b""")
def j03(spark: SparkSession, d: str) -> DataFrame:
    n, e = call_graph(spark, d)
    return G.callers(n, e)


@query("j05_callees", CTE + f""", df as (select name, count(distinct file_path) as files from n group by name), dm as (select name, {PFX.format('file_path')} as prefix, count(distinct file_path) as files_here from n group by 1, 2),
b as (select e.source_qualified as caller, n.qualified_name as target, n.name, e.file_path = n.file_path as same, df.files, dm.files_here, {PFX.format('e.file_path')} = dm.prefix as mod, max((e.file_path = n.file_path)::int) over (partition by e.source_qualified, n.name) as has_local
 from e join n on e.target_qualified = n.name join df on df.name = n.name join dm on dm.name = n.name and dm.prefix = {PFX.format('n.file_path')})
select distinct e.source_qualified as caller, n.qualified_name as target from e join n on e.target_qualified = n.qualified_name
union select e.source_qualified, n.qualified_name from e join n on e.target_qualified = n.parent_name || '::' || n.name
union select caller, target from b where same or (has_local = 0 and name not in ({COMMON}) and (files = 1 or (mod and files_here = 1)))""")
def j05(spark: SparkSession, d: str) -> DataFrame:
    n, e = call_graph(spark, d)
    return G.callees(n, e)


TRAITS = ", ".join(f"'{x}'" for x in ("main", *G.TRAIT_NAMES))


@query("j30_dead_nodes", CTE + f""" select qualified_name, kind from n where not is_test and name not in ({TRAITS}) and qualified_name not in (select target_qualified from e) and name not in (select target_qualified from e)
 and (parent_name is null or parent_name || '::' || name not in (select target_qualified from e))""")
def j30(spark: SparkSession, d: str) -> DataFrame:
    n, e = call_graph(spark, d)
    return G.dead_nodes(n, e).select("qualified_name", "kind")


@query("a05_graph_counts", CTE + " select (select count(*) from n) as nodes, (select count(*) from e) as edges")
def a05(spark: SparkSession, d: str) -> DataFrame:
    n, e = call_graph(spark, d)
    return n.agg(F.count("*").alias("nodes")).crossJoin(e.agg(F.count("*").alias("edges")))


FAN = """with e as (select distinct l_suppkey as src, (l_partkey % (select count(*) from supplier)) as dst from lineitem),
c as (select s_suppkey as path, (select count(*) from e where dst = s_suppkey and src in (select s_suppkey from supplier)) as fan_in, (select count(*) from e where src = s_suppkey and dst in (select s_suppkey from supplier)) as fan_out from supplier)"""


def fan_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("path"), "s_name", "s_acctbal", "s_nationkey")
    n = s.count()
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % n).alias("dst")).distinct()
    return s, e


@query("a09_coupling", FAN + " select * from c")
def a09(spark: SparkSession, d: str) -> DataFrame:
    return G.coupling(*fan_graph(spark, d))


@query("a10_adaptive_layer", FAN + """, t as (select greatest(2 * coalesce((select fan_in from c where fan_in > 0 order by fan_in limit 1 offset (select count(*) // 2 from c where fan_in > 0)), 1), 3) as th)
select path, case when fan_in >= th then 'utility' when fan_in = 0 and fan_out > 0 then 'entry' when fan_out = 0 then 'leaf' else 'service' end as layer, th::bigint as threshold from c, t""")
def a10(spark: SparkSession, d: str) -> DataFrame:
    c = G.coupling(*fan_graph(spark, d))
    t = G.adaptive_threshold(c)
    layer = F.when(F.col("fan_in") >= F.col("threshold"), "utility").when((F.col("fan_in") == 0) & (F.col("fan_out") > 0), "entry").when(F.col("fan_out") == 0, "leaf").otherwise("service")
    return c.join(F.broadcast(t)).select("path", layer.alias("layer"), F.col("threshold").cast("long").alias("threshold"))


@query("r15_cycles_scc", """with recursive e as (select distinct user_id as src, nxt as dst from (select user_id, lead(user_id) over (order by ts, event_id) as nxt from events) where nxt is not null and user_id <> nxt),
c(a, b) as (select src, dst from e union select c.a, e.dst from c join e on e.src = c.b),
m as (select x.a as node, least(x.a, min(x.b)) as component from c x join c y on x.a = y.b and x.b = y.a where x.a <> x.b group by x.a)
select node, component, count(*) over (partition by component) as size from m""")
def r15(spark: SparkSession, d: str) -> DataFrame:
    from loamline.operators.intervals import next_value

    ev = next_value(table(spark, d, "events").select("event_id", "ts", "user_id"), "ts", "event_id", "user_id", "nxt")
    e = ev.filter("nxt is not null and user_id <> nxt").select(F.col("user_id").alias("src"), F.col("nxt").alias("dst")).distinct()
    return G.scc(e)


COV = """with recursive t as (select distinct 'o' || o_orderkey::varchar as test from orders where o_totalprice < 10000),
e as (select distinct 'o' || l_orderkey::varchar as src, 'p' || l_partkey::varchar as dst from lineitem union select distinct 'p' || l_partkey::varchar, 's' || l_suppkey::varchar from lineitem),
b(test, node, hops) as (select test, test, 0 from t union select b.test, e.dst, hops + 1 from b join e on e.src = b.node where hops < 3),
m as (select node as function, test, min(hops) as hops from b where hops > 0 and node not in (select test from t) group by 1, 2)"""


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """What tests reach: orders in progress are the tests."""
    o, p, s = (F.concat(F.lit(x), F.col(c).cast("string")) for x, c in (("o", "l_orderkey"), ("p", "l_partkey"), ("s", "l_suppkey")))
    li = table(spark, d, "lineitem")
    e = li.select(o.alias("src"), p.alias("dst")).unionByName(li.select(p.alias("src"), s.alias("dst"))).distinct()
    t = table(spark, d, "orders").filter("o_totalprice < 10000").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("test")).distinct()
    return G.coverage_map(e, t, 3)


@query("a22_coverage_map", COV + " select * from m")
def a22(spark: SparkSession, d: str) -> DataFrame:
    return coverage(spark, d)


@query("a23_test_suggestions", COV + " select test, count(distinct function) as covers, min(hops) as hops from m where function in (select 'p' || p_partkey::varchar from part where p_size <= 10) group by test")
def a23(spark: SparkSession, d: str) -> DataFrame:
    changed = table(spark, d, "part").filter("p_size <= 10").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("function"))
    return G.suggest_tests(coverage(spark, d), changed)


@query("a23_uncovered", COV + " select 'p' || p_partkey::varchar as function from part where p_size <= 10 and 'p' || p_partkey::varchar not in (select function from m)")
def a23u(spark: SparkSession, d: str) -> DataFrame:
    changed = table(spark, d, "part").filter("p_size <= 10").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("function"))
    return changed.join(coverage(spark, d).select("function").distinct(), "function", "left_anti")


@query("r14_communities")
def r14(spark: SparkSession, d: str) -> DataFrame:
    return G.label_propagation(R.similarity_edges(table(spark, d, "embeddings"), 0.3))


RAG = f"""with recursive s as (select id, score from ({bm25_sql(limit=10)})), d0 as (select doc_id, source from documents),
c as (select distinct b.doc_id as id, 1 as hops from s join d0 a on a.doc_id = s.id join d0 b on b.source = a.source and b.doc_id between a.doc_id - 40 and a.doc_id + 40 where b.doc_id not in (select id from s))"""


@query("r11_rag_rank", RAG + """ select id, round(0.6 * score / (select max(score) from s) + 0.4, 6) as score, 'semantic' as origin from s union all select id, round(0.4 / hops, 6), 'structural' from c""")
def r11(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    seeds = R.bm25(docs, list(TERMS), "doc_id", "text", 10)
    seeds = cut(seeds)
    top = seeds.agg(F.max("score").alias("top"))
    seeds = seeds.join(F.broadcast(top)).select("id", (F.col("score") / F.col("top")).alias("s"))
    d0 = docs.select("doc_id", "source")
    a = seeds.join(d0, seeds["id"] == d0["doc_id"]).select(F.col("doc_id").alias("seed"), "source")
    ctx = a.join(d0, "source").filter("doc_id between seed - 40 and seed + 40").select(F.col("doc_id").alias("id"), F.lit(1).alias("hops")).distinct()
    return R.merge_ranked(seeds, ctx, ["id"]).select("id", "score", "origin")


@query("r10_rag_expand", RAG + " select id, hops from c")
def r10(spark: SparkSession, d: str) -> DataFrame:
    return r11(spark, d).filter("origin = 'structural'").select("id", F.lit(1).alias("hops"))


CROSS = f"""with b as ({bm25_sql(limit=None)}), r as (select source, id, score, row_number() over (partition by source order by score desc, id) as rn from b join documents on doc_id = id),
t as (select * from r where rn <= 3), p as (select source, max(score) as best from t group by source having max(score) >= 0.2), o as (select source, best, row_number() over (order by best desc, source) as pos, count(*) over () as n from p)"""


@query("r13_cross_rag", CROSS + " select source, id, score, rn::int as rn from t")
def r13(spark: SparkSession, d: str) -> DataFrame:
    from loamline.operators.intervals import last_n

    docs = table(spark, d, "documents")
    hits = R.bm25(docs, list(TERMS), "doc_id", "text").join(docs.select(F.col("doc_id").alias("id"), "source"), "id")
    return last_n(hits, ["source"], [F.desc("score"), F.col("id")], 3).select("source", "id", "score", "rn")


@query("t04_related_floor", CROSS + " select source, best, (n - 5)::bigint as omitted from o where pos <= 5")
def t04(spark: SparkSession, d: str) -> DataFrame:
    best = r13(spark, d).groupBy("source").agg(F.max("score").alias("best")).filter("best >= 0.2")
    n = best.agg((F.count("*") - 5).alias("omitted"))
    return best.orderBy(F.desc("best"), "source").limit(5).join(F.broadcast(n))
