"""Queries of lookups, views and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.operators import lookups as K
from loamline.operators import retrieval as R
from loamline.plans.basics import CTE, FAN, TERMS, TOK, call_graph, fan_graph, table
from loamline.plans.code import CALLEES, CODE_EDGES, CODE_NODES, NAMED, code_graph
from loamline.plans.registry import query


@query("f03_names_in_files", CTE + " select qualified_name from n where file_path in (select distinct 'm' || (p_partkey % 8)::varchar || '/f' || (p_partkey % 64)::varchar || '.py' from part where p_size <= 3)")
def f03(spark: SparkSession, d: str) -> DataFrame:
    n, _ = call_graph(spark, d)
    files = n.join(table(spark, d, "part").filter("p_size <= 3").select("p_partkey"), "p_partkey").select("file_path")
    return K.names_in_files(n, files)


@query("f04_stored_hash", "select sha256(coalesce(text, '')) as digest from documents where doc_id = 7 limit 1")
def f04(spark: SparkSession, d: str) -> DataFrame:
    hashes = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return K.stored_hash(hashes, "7")


MOST_NAMED = "(select parent_name, name from n where parent_name is not null group by 1, 2 order by count(*) desc, parent_name, name limit 1)"


@query("f07_members", CTE + f" select qualified_name from n where (parent_name, name) in {MOST_NAMED}")
def f07(spark: SparkSession, d: str) -> DataFrame:
    n, _ = call_graph(spark, d)
    top = n.filter("parent_name is not null").groupBy("parent_name", "name").count().orderBy(F.desc("count"), "parent_name", "name").first()
    return K.members(n, top["parent_name"], top["name"])


@query("f07_named_in_file", CTE + " select qualified_name from n where (name, file_path) in (select name, file_path from n group by 1, 2 order by count(*) desc, name, file_path limit 1)")
def f07b(spark: SparkSession, d: str) -> DataFrame:
    n, _ = call_graph(spark, d)
    top = n.groupBy("name", "file_path").count().orderBy(F.desc("count"), "name", "file_path").first()
    return K.named_in_file(n, top["name"], top["file_path"])


@query("f08_nodes_of_file", CTE + " select qualified_name, kind from n where file_path = 'm3/f11.py'")
def f08(spark: SparkSession, d: str) -> DataFrame:
    n, _ = call_graph(spark, d)
    return K.of_file(n.withColumn("file_path", F.translate("file_path", "/", "\\")), "m3/f11.py").select("qualified_name", "kind")


@query("f16_visible_edges", FAN + ", v as (select path from c where (select count(*) from c) <= 20 or fan_in > 1 or fan_out > 1 or path % 9 > 5) select distinct src, dst from e where src in (select path from v) and dst in (select path from v)")
def f16(spark: SparkSession, d: str) -> DataFrame:
    from loamline.operators import graph as G

    s, e = fan_graph(spark, d)
    m = G.coupling(s, e).withColumn("complexity", F.col("path") % 9)
    return K.visible(m, e, 20)[1].select("src", "dst").distinct()


@query("j05_callees_low_confidence", f"with {CODE_NODES}, {CODE_EDGES}, {NAMED}, {CALLEES}, b as (select distinct source_qualified as caller, target_qualified as name from e), st as (select distinct ce.caller, n.name from ce join n on n.qualified_name = ce.target), lo as (select distinct b.caller, n.qualified_name as target from b join n using (name) where (b.caller, b.name) not in (select caller, name from st)) select caller, target, 'high' as confidence from ce union all select caller, target, 'low' from lo")
def j05l(spark: SparkSession, d: str) -> DataFrame:
    return K.low_confidence_callees(*code_graph(spark, d))


@query("j32_module_communities", "with c as (select source as file, doc_id % 5 as community from documents where lang <> 'en' or doc_id % 5 < 4), p as (select file, community, count(*) as n from c group by 1, 2) select file, min(community) as community from p where (file, n) in (select file, max(n) from p group by file) group by file")
def j32(spark: SparkSession, d: str) -> DataFrame:
    own = F.when((F.col("lang") != "en") | (F.col("doc_id") % 5 < 4), F.col("doc_id") % 5)
    return K.module_communities(table(spark, d, "documents").select(F.col("source").alias("file"), own.alias("community")))


NEEDLES = ("ring", "steel", "large")


@query(
    "r09_resolve_symbols",
    CTE
    + ", h as ("
    + " union all ".join(f"select distinct {i} as symbol, qualified_name, case when name = '{s}' then 0 when lower(qualified_name) like '%::{s}' then 1 else 2 end as rank from n where name = '{s}' or contains(lower(name), '{s}') or contains(lower(qualified_name), '{s}')" for i, s in enumerate(NEEDLES))
    + "), r as (select *, row_number() over (partition by symbol order by rank, length(qualified_name), qualified_name) as rn from h) select distinct qualified_name from r where rn <= 3",
)
def r09(spark: SparkSession, d: str) -> DataFrame:
    n, _ = call_graph(spark, d)
    return K.resolve_symbols(list(NEEDLES), n.select("name", "qualified_name").distinct())


DEAD = f"""with recursive n0 as (select *, ['#[tool]', '#[derive(Debug, Args)]', '/// text', ''][1 + p_size % 4] as above, ['rust', 'go', 'dart', 'javascript', 'python'][1 + p_partkey % 5] as language, ['pub fn', '  export function', 'fn'][1 + p_size % 3] as decl from part),
{CTE.split('with recursive ', 1)[1].split(', e as (', 1)[0]}, e as ({CTE.split(', e as (', 1)[1][:-1]}), x as (select n.*, n0.above, n0.language, n0.decl, (n.p_partkey * 7 % 1000)::int as line_start from n join n0 using (p_partkey))"""


@query(
    "t06_dead_report",
    DEAD
    + """, c as (select *, case when case language when 'rust' then starts_with(ltrim(decl), 'pub') when 'go' then regexp_matches(name, '^[A-Z]') when 'dart' then not starts_with(name, '_') when 'javascript' then contains(decl, 'export') else true end then 'medium' else 'high' end as confidence from x
 where not is_test and name not in ('main', """
    + ", ".join(f"'{t}'" for t in K.G.TRAIT_NAMES)
    + """) and qualified_name not in (select target_qualified from e) and name not in (select target_qualified from e) and (parent_name is null or parent_name || '::' || name not in (select target_qualified from e))
 and file_path not in ('m1/f1.py', 'm2/f2.py') and not contains(above, '#[tool') and not (contains(above, 'derive(') and contains(above, 'Args')))
 select qualified_name, confidence, file_path, line_start, (select count(*) from c) as total_found from c order by confidence, file_path, line_start, qualified_name limit 40""",
)
def t06(spark: SparkSession, d: str) -> DataFrame:
    n, e = call_graph(spark, d)
    s, k = F.col("p_size"), F.col("p_partkey")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (1 + i % len(xs)).cast("int"))
    more = table(spark, d, "part").select("p_partkey", pick(("#[tool]", "#[derive(Debug, Args)]", "/// text", ""), s).alias("above"), pick(("rust", "go", "dart", "javascript", "python"), k).alias("language"), pick(("pub fn", "  export function", "fn"), s).alias("decl"))
    x = n.join(more, "p_partkey").withColumn("line_start", (F.col("p_partkey") * 7 % 1000).cast("int"))
    contracts = spark.createDataFrame([("m1\\f1.py",), ("m2/f2.py",)], "file_path string")
    return K.dead_report(K.dead_candidates(x, e, contracts), 40).select("qualified_name", "confidence", "file_path", "line_start", "total_found")


REG = """p as (select 'p' || s_suppkey::varchar as project, '/w/' || n_name || case when s_suppkey % 3 = 0 then '/a' when s_suppkey % 3 = 1 then '/b' || s_suppkey::varchar else '' end as path, case when s_suppkey % 4 = 0 then '/w/' || n_name || '/svc' end as service_dir, date '1998-01-01' + (s_suppkey % 15)::int as indexed_at, s_suppkey from supplier join nation on n_nationkey = s_nationkey),
fo as (select distinct path from p where s_suppkey % 5 <> 0), ix as (select upper('p' || s_suppkey::varchar) as name from supplier union all select 'old' || r_regionkey::varchar from region), th as (select * from p where path in (select path from fo))"""


@query(
    "j34_registry_issues",
    f"""with {REG} select project, 'missing_path' as issue, path as detail from p where path not in (select path from fo) union all select project, 'duplicate_path', path from (select *, row_number() over (partition by path order by project) as rn from th) where rn > 1
 union all select distinct a.project, 'nested', b.path from th a join (select distinct path from th) b on a.path <> b.path and starts_with(a.path, b.path || '/') union all select project, 'broken_dir', service_dir from p where service_dir is not null and service_dir not in (select path from fo)
 union all select project, 'stale_index', (date '1998-01-15' - indexed_at::date)::varchar from p where date '1998-01-15' - indexed_at::date > 7 union all select null, 'orphan_index', name from ix where lower(name) not in (select lower(project) from p)""",
)
def j34i(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    tail = F.when(k % 3 == 0, "/a").when(k % 3 == 1, F.concat(F.lit("/b"), k.cast("string"))).otherwise("")
    p = s.select(F.concat(F.lit("p"), k.cast("string")).alias("project"), F.concat(F.lit("/w/"), "n_name", tail).alias("path"), F.when(k % 4 == 0, F.concat(F.lit("/w/"), "n_name", F.lit("/svc"))).alias("service_dir"), F.date_add(F.lit("1998-01-01").cast("date"), (k % 15).cast("int")).alias("indexed_at"), "s_suppkey")
    folders = p.filter("s_suppkey % 5 <> 0").select("path")
    old = table(spark, d, "region").select(F.concat(F.lit("old"), F.col("r_regionkey").cast("string")).alias("name"))
    return K.registry_health(p.drop("s_suppkey"), folders, p.select(F.upper("project").alias("name")).union(old), "1998-01-15")


@query(
    "r06_hashed_embedding",
    f"""with t as (select doc_id as id, unnest(regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '{TOK}')) as t from documents), tf as (select id, t, count(*) as tf from t group by 1, 2), df as (select t, count(*) as df from tf group by 1), n as (select count(distinct id) as n from tf),
w as (select id, (('0x' || substr(md5(t), 1, 4))::int % 64) as b, sum(tf * ln(1 + n / df)) as w from tf join df using (t), n group by 1, 2), q as (select id, sqrt(sum(w * w)) as norm from w group by 1)
select id, round(max(case when b = 7 then w else 0 end) / max(norm), 6) as v7, round(max(case when b = 40 then w else 0 end) / max(norm), 6) as v40, round(sum(w * b) / max(norm), 4) as mixed from w join q using (id) group by id""",
)
def r06(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    e = K.hashed_embedding(docs, "doc_id", R.tokens(F.coalesce("text", F.lit(""))))
    mixed = F.aggregate(F.zip_with("embedding", F.sequence(F.lit(0), F.lit(63)), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return e.select("id", F.round(F.element_at("embedding", 8), 6).alias("v7"), F.round(F.element_at("embedding", 41), 6).alias("v40"), F.round(mixed, 4).alias("mixed"))


@query("sc_vector_blobs", "select vec_id as id, (4 * len(embedding))::int as bytes from embeddings where embedding is not null")
def blobs(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of every vector's blob; those that don't come back as they were are left out."""
    v = table(spark, d, "embeddings").filter("embedding is not null")
    b = K.as_blobs(v, "vec_id", "embedding")
    back = K.as_blobs(b, "id", "blob", back=True).join(v.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("was")), "id").filter("vector = was").select("id")
    return b.join(back, "id", "left_semi").select("id", F.octet_length("blob").alias("bytes"))


@query("r14_modularity")
def r14m(spark: SparkSession, d: str) -> DataFrame:
    return K.communities(R.similarity_edges(table(spark, d, "embeddings"), 0.3))


@query("r12_semantic_only", "select 'documents' as part, true as degraded, 0::bigint as context")
def r12(spark: SparkSession, d: str) -> DataFrame:
    """A ranking whose seeds have no structural context says so: documents are in no call graph."""
    seeds = R.bm25(table(spark, d, "documents"), list(TERMS), "doc_id", "text", 10).select("id", F.lit(1.0).alias("s"))
    n, e = call_graph(spark, d)
    context = seeds.select(F.col("id").cast("string").alias("node")).join(n.select(F.col("qualified_name").alias("node")), "node", "left_semi").select(F.lit(0).cast("long").alias("id"), F.lit(1).alias("hops"))
    got = R.merge_ranked(seeds, context, ["id"])
    return got.agg((F.sum((F.col("origin") == "structural").cast("int")) == 0).alias("degraded"), F.sum((F.col("origin") == "structural").cast("long")).alias("context")).select(F.lit("documents").alias("part"), "degraded", "context")


ARCH = """with m as (select s_suppkey as path, ['controller', 'service', 'repository', 'model', 'utility'][1 + s_nationkey % 5] as layer from supplier), i as (select distinct l_suppkey as src, l_partkey % (select count(*) from supplier) as dst from lineitem),
h as (select count(*) as n, bool_or(layer = 'controller') as c, bool_or(layer = 'service') as s, bool_or(layer = 'repository') as r, bool_or(layer = 'model') as d from m),
k as (select case when c and s and r and d then case when not exists (select 1 from i join m a on a.path = src join m b on b.path = dst where b.layer = 'controller' and a.layer in ('service', 'model')) then 'clean_hexagonal' else 'layered_full' end when c and d and not s then 'mvc' when c and s then 'layered' when n > 20 and not c and not s then 'monolith_large' when n <= 5 then 'monolith_small' else 'unknown' end as k from h)
select split_part(k, '_', 1) as pattern, """ + "case k " + " ".join(f"when '{k}' then {v}" for k, v in K.PATTERNS.items()) + " end::double as confidence from k"


@query("a12_architecture", ARCH)
def a12a(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    n = s.count()
    layer = F.element_at(F.array(*map(F.lit, ("controller", "service", "repository", "model", "utility"))), (1 + F.col("s_nationkey") % 5).cast("int"))
    i = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % n).alias("dst")).distinct()
    return K.architecture(s.select(F.col("s_suppkey").alias("path"), layer.alias("layer")), i)


TASKS = """t as (select 'b' || (p_partkey % 3)::varchar as board, ['Todo', 'Doing', 'DONE'][1 + p_size % 3] as col, 't' || p_partkey::varchar as task, ['m' || (p_partkey % 8)::varchar || '/f' || (p_partkey % 64)::varchar || '.py', 'f' || (p_partkey % 64)::varchar || '.py', 'repo/m' || (p_partkey % 8)::varchar || '/f' || (p_partkey % 64)::varchar || '.py', 'sym' || (p_partkey % 50)::varchar][1 + p_size % 4] as l from part),
f as (select distinct 'm' || (s_suppkey % 8)::varchar || '/f' || (s_suppkey % 64)::varchar || '.py' as f from supplier where s_acctbal < 2000), y as (select 'a::b::sym' || n_nationkey::varchar as s from nation)"""


@query("j25_tasks_of_changes", f"with {TASKS} select distinct board, task from t where lower(col) <> 'done' and (exists (select 1 from f where f = l or ends_with(f, '/' || l) or ends_with(l, '/' || f)) or exists (select 1 from y where s = l or split_part(s, '::', 3) = l))")
def j25t(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    f = F.concat(F.lit("f"), (k % 64).cast("string"), F.lit(".py"))
    whole = F.concat(F.lit("m"), (k % 8).cast("string"), F.lit("/"), f)
    link = F.element_at(F.array(F.translate(whole, "/", "\\"), f, F.concat(F.lit("repo/"), whole), F.concat(F.lit("sym"), (k % 50).cast("string"))), (1 + s % 4).cast("int"))
    column = F.element_at(F.array(*map(F.lit, ("Todo", "Doing", "DONE"))), (1 + s % 3).cast("int"))
    tasks = table(spark, d, "part").select(F.concat(F.lit("b"), (k % 3).cast("string")).alias("board"), column.alias("column"), F.concat(F.lit("t"), k.cast("string")).alias("task"), F.array(link).alias("links"))
    files = table(spark, d, "supplier").filter("s_acctbal < 2000").select(F.concat(F.lit("m"), (F.col("s_suppkey") % 8).cast("string"), F.lit("/f"), (F.col("s_suppkey") % 64).cast("string"), F.lit(".py")).alias("file"))
    symbols = table(spark, d, "nation").select(F.concat(F.lit("a::b::sym"), F.col("n_nationkey").cast("string")).alias("symbol"))
    return K.tasks_touching(tasks, files, symbols)


@query("j36_typed_resolution", CTE + """, nl as (select *, (p_partkey * 13 % 997)::int as line_start from n), b as (select file_path, name as k, arg_min(qualified_name, (line_start, qualified_name)) as r from nl group by 1, 2 union all select file_path, parent_name || '::' || name, arg_min(qualified_name, (line_start, qualified_name)) from nl where parent_name <> '' group by 1, 2)
select source_qualified, e.file_path, coalesce(r, target_qualified) as target_qualified from e left join b on b.file_path = e.file_path and b.k = target_qualified and not contains(target_qualified, '/') and not contains(target_qualified, '.')""")
def j36t(spark: SparkSession, d: str) -> DataFrame:
    n, e = call_graph(spark, d)
    return K.resolve_local(n.withColumn("line_start", (F.col("p_partkey") * 13 % 997).cast("int")), e)


LOG = "lg as (select l_suppkey as file, l_orderkey * 10 + l_linenumber as line, min(case l_linenumber % 4 when 0 then 'INFO ' || l_shipdate::date::varchar when 1 then chr(27) || '[31mERROR ' || l_returnflag || chr(27) || '[0m' when 2 then '  42%' else 'plain ' || l_returnflag end) as content from lineitem group by 1, 2)"


@query(
    "st06_quiet_logs",
    f"""with {LOG}, a as (select file, line, regexp_replace(content, chr(27) || '\\[[0-9;?]*[A-Za-z]', '', 'g') as c from lg), b as (select * from a where c <> '  42%'), r as (select *, case when lag(c) over w = c then 0 else 1 end as nw from b window w as (partition by file order by line)),
g as (select *, sum(nw) over (partition by file order by line) as run from r), u as (select file, run, min(line) as line, min(c) as c, count(*) as n from g group by 1, 2), v as (select file, line, case when n > 1 then c || ' (×' || n::varchar || ')' else c end as c from u),
x as (select *, sum((contains(upper(c), 'INFO') or contains(upper(c), 'ERROR'))::int) over (partition by file) as lv, count(*) over (partition by file) as al from v), y as (select file, line, c from x where not (lv * 5 >= al and lv > 0 and contains(upper(c), 'INFO') and not contains(upper(c), 'ERROR'))),
z as (select *, row_number() over (partition by file order by line) as rn, count(*) over (partition by file) as n from y)
select file, (case when n > 150 and rn > 21 then rn - n + 51 else rn end)::bigint as position, case when n > 150 and rn = 21 then '... [' || (n - 50)::varchar || ' lines omitted] ...' else c end as content from z where n <= 150 or rn <= 21 or rn > n - 30""",
)
def st06q(spark: SparkSession, d: str) -> DataFrame:
    from loamline.operators import logs

    return logs.quiet(log_lines(spark, d))


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_linenumber") % 4
    esc = F.lit("\x1b")
    error = F.concat(esc, F.lit("[31mERROR "), "l_returnflag", esc, F.lit("[0m"))
    content = F.when(k == 0, F.concat(F.lit("INFO "), F.col("l_shipdate").cast("date").cast("string"))).when(k == 1, error).when(k == 2, "  42%").otherwise(F.concat(F.lit("plain "), "l_returnflag"))
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), content.alias("content")).groupBy("file", "line").agg(F.min("content").alias("content"))


@query(
    "a30_timeline_lists",
    "with c as (select strftime(o_orderdate, '%Y-%m') as period, list_sort(list(o_orderkey)) as commits from orders group by 1), t as (select strftime(m, '%Y-%m') as period, list_sort(list(l_suppkey)) as tasks from (select l_suppkey, max(l_shipdate) as m from lineitem group by 1) group by 1) select coalesce(c.period, t.period) as period, coalesce(commits, []) as commits, coalesce(tasks, []) as tasks from c full join t on c.period = t.period",
)
def a30l(spark: SparkSession, d: str) -> DataFrame:
    from loamline.operators import metrics as M

    commits = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderdate").alias("ts"))
    tasks = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("id")).agg(F.max("l_shipdate").alias("ts"))
    return M.timeline(commits, tasks, "month")


@query("t03_nearest_context", "with c as (select l_partkey as part, min(l_linenumber) as hops, min(l_suppkey) as supp from lineitem group by 1) select part, hops, supp from c order by hops, supp, part limit 20")
def t03(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("hops"), F.col("l_suppkey").alias("supp"))
    return R.nearest_context(c, ["part"], ["supp", "part"]).select("part", "hops", "supp")
