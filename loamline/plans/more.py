"""Queries over the tables, fourth part: lookups, predicates, prefix and suffix joins, set operations, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.functions import scalars as S
from loamline.operators import contracts as C
from loamline.operators import intervals as I
from loamline.operators import lookups as U
from loamline.operators import retrieval as R
from loamline.plans.basics import CTE, call_graph, table
from loamline.plans.lines_and_time import LINES, doc_lines
from loamline.plans.registry import query
from loamline.plans.rules import FINDINGS, found
from loamline.sources import code
from loamline.sources import files as X

PAGE_PATH = "regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '[?#].*$', '')"


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.expr(PAGE_PATH).alias("path"), "html")


@query("f01_point_lookup", CTE + " select qualified_name, kind from n where qualified_name in (select target_qualified from e)")
def f01(spark: SparkSession, d: str) -> DataFrame:
    n, e = call_graph(spark, d)
    return n.join(e.select(F.col("target_qualified").alias("qualified_name")), "qualified_name", "left_semi").select("qualified_name", "kind")


@query("f02_names_limit", CTE + " select qualified_name from n where name in (select target_qualified from e) order by qualified_name limit 40")
def f02(spark: SparkSession, d: str) -> DataFrame:
    n, e = call_graph(spark, d)
    return n.join(e.select(F.col("target_qualified").alias("name")), "name", "left_semi").select("qualified_name").orderBy("qualified_name").limit(40)


@query("f06_definition_files", CTE + " select name, count(distinct file_path) as files, min(file_path) as one_file from n where kind <> 'File' group by name")
def f06(spark: SparkSession, d: str) -> DataFrame:
    from loamline.operators.graph import definitions

    return definitions(call_graph(spark, d)[0])


@query("f09_ignore_rules", f"select page_id, path from (select page_id, {PAGE_PATH} as path from pages) where not (ends_with(path, '/') or starts_with(path, 'm.') or starts_with(path, 'fr/') or contains(path, '/fr/'))")
def f09(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    return p.filter(~X.ignored(F.col("path"), ["*/", "m.", "fr/", "# a comment", ""])).select("page_id", "path")


@query("f12_test_paths", r"select path, regexp_matches(path, '(^|/)(tests?|__tests__|spec)/|(^|/)(test_[^/]*|[^/]*_test\.[^/]*|[^/]*\.(test|spec)\.[^/]*)$') as is_test, count(*) as n from (select case when p_size % 4 = 0 then 'tests/' when p_size % 4 = 1 then 'src/test_' else 'src/' end || replace(p_name, ' ', '_') || '.py' as path from part) group by path")
def f12(spark: SparkSession, d: str) -> DataFrame:
    head = F.when(F.col("p_size") % 4 == 0, "tests/").when(F.col("p_size") % 4 == 1, "src/test_").otherwise("src/")
    p = table(spark, d, "part").select(F.concat(head, F.translate("p_name", " ", "_"), F.lit(".py")).alias("path"))
    return p.groupBy("path").agg(F.count("*").alias("n")).withColumn("is_test", X.is_test_path(F.col("path")))


@query("w07_lowest_hop", "select l_partkey, l_suppkey, l_orderkey from (select *, row_number() over (partition by l_partkey, l_suppkey order by l_linenumber, l_orderkey) as rn from lineitem) where rn = 1")
def w07(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(F.struct("l_linenumber", "l_orderkey")).alias("m")).select("l_partkey", "l_suppkey", "m.l_orderkey")


@query("w11_running_depth", f"""with {LINES}, s as (select file, line, sum(length(content) - length(replace(content, ',', '')) - 2 * (length(content) - length(replace(content, '.', '')))) over (partition by file order by line) as s from l)
select file, line, (s - least(0, min(s) over (partition by file order by line rows between unbounded preceding and current row)))::bigint as depth from s""")
def w11(spark: SparkSession, d: str) -> DataFrame:
    """Depth floored at zero: the running sum less its least value so far."""
    delta = F.length(F.col("content")) - F.length(F.translate("content", ",", "")) - 2 * (F.length("content") - F.length(F.translate("content", ".", "")))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    s = doc_lines(spark, d).withColumn("s", F.sum(delta).over(w))
    return s.select("file", "line", (F.col("s") - F.least(F.lit(0), F.min("s").over(w))).cast("long").alias("depth"))


@query("j19_import_resolution", """with i as (select distinct l_partkey as src, ['p' || (l_suppkey * 3)::varchar, 'p' || l_suppkey::varchar, 'p' || (l_suppkey + 1)::varchar] as c from lineitem), m as (select 'p' || p_partkey::varchar as path from part where p_size % 3 = 0),
x as (select src, c, unnest(c) as path, generate_subscripts(c, 1) as r from i), y as (select src, c, arg_min(path, r) as resolved from x where path in (select path from m) group by src, c)
select i.src, i.c[2] as second, resolved from i left join y on y.src = i.src and y.c = i.c""")
def j19(spark: SparkSession, d: str) -> DataFrame:
    p = lambda c: F.concat(F.lit("p"), c.cast("string"))
    s = F.col("l_suppkey")
    i = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.array(p(s * 3), p(s), p(s + 1)).alias("c")).distinct()
    m = table(spark, d, "part").filter("p_size % 3 = 0").select(p(F.col("p_partkey")).alias("path"))
    return C.first_existing(i, m, ["src", "c"], "c", "path").select("src", F.get("c", 1).alias("second"), "resolved")


@query("j20_suffix_join", f"""with p as (select page_id, {PAGE_PATH} as path from pages), s as (select distinct regexp_extract(path, '([^/]+/[^/]+)$', 1) as suffix from p where page_id % 3 = 0 and regexp_matches(path, '[^/]+/[^/]+$')),
h as (select page_id, max(suffix) as suffix from p join s on path = suffix or ends_with(path, '/' || suffix) group by page_id) select p.page_id, h.suffix from p left join h on h.page_id = p.page_id""")
def j20(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    s = p.filter(F.col("page_id") % 3 == 0).select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("suffix")).filter("suffix <> ''").distinct()
    return C.suffix_join(p.select("page_id", "path"), s, "path", "suffix", []).join(C.suffix_join(p.select("path").distinct(), s.withColumn("found", F.col("suffix")), "path", "suffix", ["found"]), "path").select("page_id", F.col("found").alias("suffix"))


@query("j23_longest_prefix", f"""with p as (select page_id, {PAGE_PATH} as path from pages), r as (select distinct split_part(path, '/', 1) as root from p where page_id % 2 = 0 union select distinct split_part(path, '/', 1) || '/' || split_part(path, '/', 2) from p where page_id % 3 = 0 and split_part(path, '/', 2) <> ''),
h as (select page_id, arg_max(root, length(root)) as root from p join r on path = root or starts_with(path, root || '/') group by page_id) select p.page_id, h.root from p left join h on h.page_id = p.page_id""")
def j23(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d).select("page_id", "path")
    part = lambda i: F.split_part("path", F.lit("/"), F.lit(i))
    r = p.filter("page_id % 2 = 0").select(part(1).alias("root")).union(p.filter("page_id % 3 = 0").filter(part(2) != "").select(F.concat(part(1), F.lit("/"), part(2)))).distinct()
    return C.longest_prefix(p, r, "path", "root").select("page_id", "root")


@query("j24_tier_pairs", "select r_name, n_name from region cross join nation where r_regionkey <> n_regionkey")
def j24(spark: SparkSession, d: str) -> DataFrame:
    """Every tier with every other: both sides are a handful of rows by nature."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    return r.crossJoin(F.broadcast(n)).filter("r_regionkey <> n_regionkey").select("r_name", "n_name")


@query("j25_tasks_touching", f"""with p as (select page_id, {PAGE_PATH} as path from pages), f as (select distinct regexp_extract(path, '([^/]+)$', 1) as changed from p where page_id % 10 = 0) select page_id from p where regexp_extract(path, '([^/]+)$', 1) in (select changed from f where changed <> '') and page_id % 4 <> 0""")
def j25(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d).withColumn("changed", F.regexp_extract("path", "([^/]+)$", 1))
    f = p.filter("page_id % 10 = 0 and changed <> ''").select("changed").distinct()
    return p.filter("page_id % 4 <> 0").join(f, "changed", "left_semi").select("page_id")


@query("j34_registry_health", f"""with p as (select page_id, {PAGE_PATH} as path from pages), r as (select page_id, path, row_number() over (partition by path order by page_id) as rn from p)
select page_id, case when path = '' then 'missing' when rn > 1 then 'duplicate' when exists (select 1 from p q where starts_with(r.path, q.path || '/') and q.path <> '') then 'nested' else 'ok' end as health from r""")
def j34(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d).select("page_id", "path")
    rn = F.row_number().over(Window.partitionBy("path").orderBy("page_id"))
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    up = p.filter(F.size(parts) > 1).select("page_id", F.explode(ups).alias("up")).filter("up <> ''")
    nested = up.join(p.select(F.col("path").alias("up")).distinct(), "up", "left_semi").select("page_id").distinct().withColumn("nested", F.lit(True))
    h = F.when(F.col("path") == "", "missing").when(F.col("rn") > 1, "duplicate").when(F.col("nested"), "nested").otherwise("ok")
    return p.withColumn("rn", rn).join(nested, "page_id", "left").select("page_id", h.alias("health"))


@query("j35_new_findings", FINDINGS + " select distinct file, line, rule from f where file % 2 = 0 and rule || ':' || (file % 20)::varchar not in (select rule || ':' || (file % 20)::varchar from f where file % 2 = 1)")
def j35(spark: SparkSession, d: str) -> DataFrame:
    f = found(spark, d).withColumn("k", F.concat_ws(":", "rule", (F.col("file") % 20).cast("string")))
    return f.filter("file % 2 = 0").join(f.filter("file % 2 = 1").select("k"), "k", "left_anti").select("file", "line", "rule").distinct()


@query("j37_shared_symbols", "select p_name as symbol from part where p_size < 20 intersect select p_name from part where p_size >= 20")
def j37(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return U.shared(p.filter("p_size < 20").withColumnRenamed("p_name", "symbol"), p.filter("p_size >= 20").withColumnRenamed("p_name", "symbol"), "symbol")


@query("j39_member_pairs", "select distinct a.n_name as member, b.n_name as dependency from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey")
def j39(spark: SparkSession, d: str) -> DataFrame:
    return U.siblings(table(spark, d, "nation"), "n_regionkey", "n_nationkey", "n_name")


@query("a11_layer_scores", """with s as (select page_id, 2 * contains(html, '<nav')::int + 3 * contains(html, '<form')::int as view, 4 * contains(html, '<table')::int + contains(html, '<pre')::int as data, contains(html, '<p>')::int + contains(html, '<li>')::int as prose from pages)
select page_id, case when greatest(view, data, prose) = 0 then 'unknown' when view >= data and view >= prose then 'view' when data >= prose then 'data' else 'prose' end as layer from s""")
def a11(spark: SparkSession, d: str) -> DataFrame:
    signals = {"view": (("<nav", 2), ("<form", 3)), "data": (("<table", 4), ("<pre", 1)), "prose": (("<p>", 1), ("<li>", 1))}
    score = {k: sum((F.col("html").contains(t).cast("int") * w for t, w in v), F.lit(0)) for k, v in signals.items()}
    s = table(spark, d, "pages").select("page_id", *[c.alias(k) for k, c in score.items()])
    return s.select("page_id", F.when(F.greatest(*signals) == 0, "unknown").when((F.col("view") >= F.col("data")) & (F.col("view") >= F.col("prose")), "view").when(F.col("data") >= F.col("prose"), "data").otherwise("prose").alias("layer"))


@query("a15_snapshot_metrics", "select p_brand, count(*) as n, sum(p_size)::bigint as loc, max(p_size) as max_size, round(avg(p_size), 6) as avg_size, sum((p_size >= 10)::int)::bigint as complex, sum((p_type = 'SMALL')::int)::bigint as small from part group by p_brand")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return U.snapshot(table(spark, d, "part"), "p_brand", "p_size", {"complex": F.col("p_size") >= 10, "small": F.col("p_type") == "SMALL"})


@query("a34_folder_sizes", f"select split_part({PAGE_PATH}, '/', 1) as folder, sum(octet_length(encode(html)))::bigint as bytes, count(*) as files from pages group by 1")
def a34(spark: SparkSession, d: str) -> DataFrame:
    return U.folder_sizes(pages(spark, d), "path", F.octet_length("html"))


@query("a36_ignored_count", f"select count(*) filter (where ends_with(path, '/') or starts_with(path, 'm.')) as ignored, count(*) as n from (select {PAGE_PATH} as path from pages)")
def a36(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).agg(F.count(F.when(X.ignored(F.col("path"), ["*/", "m."]), 1)).alias("ignored"), F.count("*").alias("n"))


@query("t05_by_severity", FINDINGS + " select file, line, rule, severity from f order by case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end, file, line, rule limit 10")
def t05(spark: SparkSession, d: str) -> DataFrame:
    from loamline.operators.metrics import SEVERITIES

    rank = F.coalesce(*[F.when(F.col("severity") == s, i) for i, s in enumerate(SEVERITIES)])
    return found(spark, d).orderBy(rank, "file", "line", "rule").limit(10).select("file", "line", "rule", "severity")


@query("t11_numeric_suffix", "select p_brand, count(*) as n from part group by p_brand order by try_cast(regexp_extract(p_brand, '([0-9]+)$', 1) as int) nulls last limit 12")
def t11(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return g.orderBy(F.regexp_extract("p_brand", "([0-9]+)$", 1).try_cast("int").asc_nulls_last()).limit(12)


@query("set4_changed_union", f"select distinct path from (select {PAGE_PATH} as path from pages where page_id % 2 = 0 union all select {PAGE_PATH} from pages where page_id % 5 = 0)")
def set4(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    return p.filter("page_id % 2 = 0").select("path").unionByName(p.filter("page_id % 5 = 0").select("path")).distinct()


@query("set5_sorted_lists", "select source, list_sort(list(distinct lang)) as langs from documents group by source")
def set5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("langs"))


@query("set6_first_by_priority", "select l_orderkey, l_shipdate, l_linenumber from (select *, row_number() over (partition by l_orderkey order by case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end, l_linenumber, l_partkey, l_suppkey, l_shipdate) as rn from lineitem) where rn = 1")
def set6(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    m = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct(rank.alias("r"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")).alias("m"))
    return m.select("l_orderkey", "m.l_shipdate", "m.l_linenumber")


@query("scalar_marker_hash", "select doc_id, substr(sha256(lang || '|' || source || '|' || coalesce(text, '')), 1, 8) as hash, upper(regexp_replace(source, '[^A-Za-z0-9_]', '_', 'g')) as safe from documents")
def marker(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.marker_hash(F.col("lang"), F.col("source"), F.coalesce("text", F.lit(""))).alias("hash"), F.upper(S.safe_id(F.col("source"))).alias("safe"))


@query("scalar_url", """select page_id, replace(regexp_extract('see ' || url || ' now', '(https?://[^\\s"''<>]+)', 1), '0.0.0.0', 'localhost') as u from pages""")
def url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", S.url_in(F.concat(F.lit("see "), F.col("url"), F.lit(" now"))).alias("u"))


@query("r01_chunks")
def r01(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of whole documents, by lines where there are no functions."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return code.chunks(docs)


def _modes_sql() -> str:
    from loamline.plans.basics import COS, bm25_sql

    lists = f"""with b as (select id, row_number() over (order by score desc, id) as r from ({bm25_sql(limit=30)})),
v as (select id, row_number() over (order by score desc, id) as r from (select vec_id as id, round({COS}, 6) as score from embeddings order by score desc, id limit 30)),
u as (select 'hybrid' as mode, id, 1.0 / (60 + r) as w from v union all select 'hybrid', id, 1.0 / (60 + r) from b union all select 'vector', id, 1.0 / (60 + r) from v union all select 'lexical', id, 1.0 / (60 + r) from b),
s as (select mode, id, round(sum(w), 6) as score from u group by 1, 2), k as (select *, row_number() over (partition by mode order by score desc, id) as rn from s)"""
    return lists + " select mode, id, score from k where rn <= 10 and id in (select doc_id from documents)"


@query("r05_search_modes", _modes_sql())
def r05(spark: SparkSession, d: str) -> DataFrame:
    from loamline.plans.basics import TERMS, query_vector

    q = query_vector(spark, d)
    out = None
    for mode in ("hybrid", "vector", "lexical"):
        got = R.hybrid(table(spark, d, "documents"), table(spark, d, "embeddings"), " ".join(TERMS), q, 10, mode).select(F.lit(mode).alias("mode"), "id", "score")
        out = got if out is None else out.unionByName(got)
    return out


@query("w08_cap_per_seed", "select l_suppkey, l_partkey from (select l_suppkey, l_partkey, row_number() over (partition by l_suppkey order by n desc, l_partkey) as rn from (select l_suppkey, l_partkey, count(*) as n from lineitem group by 1, 2)) where rn <= 5")
def w08b(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return I.last_n(g, ["l_suppkey"], [F.desc("n"), F.col("l_partkey")], 5).select("l_suppkey", "l_partkey")
