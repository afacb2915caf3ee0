"""Queries over the tables, second part: intervals, windows, aggregates and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.operators import audit as A
from loamline.operators import intervals as I
from loamline.operators import lookups as U
from loamline.operators import metrics as M
from loamline.plans.basics import CTE, call_graph, table
from loamline.plans.lineage import cut
from loamline.plans.registry import query

LINES = "l as (select doc_id as file, unnest(string_split(coalesce(text, ''), chr(10))) as content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as line from documents)"


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return A.lines(table(spark, d, "documents"), "doc_id", "text").withColumn("line", F.col("line").cast("long"))


#: Spans of four lines, and changed ranges around lines that hold a digit run.
SPANS = "sp as (select distinct file, (line - 1) // 4 as k, file::varchar || ':' || ((line - 1) // 4)::varchar as symbol, ((line - 1) // 4) * 4 + 1 as line_start, ((line - 1) // 4) * 4 + 4 as line_end from l)"
HUNKS = "h as (select file, line as h0, line + 2 as h1, case when file % 11 = 0 then 'deleted' else 'modified' end as status from l where regexp_matches(content, '[0-9]{3}'))"


def spans(lines: DataFrame) -> DataFrame:
    k = F.floor((F.col("line") - 1) / 4)
    return lines.select("file", k.alias("k")).distinct().select("file", "k", F.concat_ws(":", F.col("file").cast("string"), F.col("k").cast("string")).alias("symbol"), (F.col("k") * 4 + 1).alias("line_start"), (F.col("k") * 4 + 4).alias("line_end"))


def hunks(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("content").rlike("[0-9]{3}")).select("file", F.col("line").alias("start"), (F.col("line") + 2).alias("end"), F.when(F.col("file") % 11 == 0, "deleted").otherwise("modified").alias("status"))


@query("j06_interval_overlap", f"""with {LINES}, {SPANS}, {HUNKS}, sp2 as (select * from sp where file % 7 <> 0 and k % 3 <> 2), hit as (select distinct h.file, symbol, h0, h1 from h join sp2 on h.file = sp2.file and line_start <= h1 and line_end >= h0 where status <> 'deleted')
select distinct file, symbol, false as is_new_file from hit
union all select distinct h.file, null, h.file not in (select file from sp2) from h where status <> 'deleted' and not exists (select 1 from hit where hit.file = h.file and hit.h0 = h.h0 and hit.h1 = h.h1)""")
def j06(spark: SparkSession, d: str) -> DataFrame:
    ln = doc_lines(spark, d)
    return I.hunks_to_symbols(spans(ln).filter("file % 7 <> 0 and k % 3 <> 2"), hunks(ln))


@query("j07_band_join", f"""with {LINES}, {HUNKS} select file, line, octet_length(encode(content))::bigint as bytes from l where (contains(content, '@') or contains(content, '"')) and exists (select 1 from h where h.file = l.file and l.line between h.h0 - 3 and h.h1 + 3)""")
def j07(spark: SparkSession, d: str) -> DataFrame:
    ln = doc_lines(spark, d)
    found = ln.filter(F.col("content").contains("@") | F.col("content").contains('"'))
    return I.near_ranges(found, hunks(ln), "file", "line", "start", "end").select("file", "line", F.octet_length("content").cast("long").alias("bytes"))


TWO_SPANS = "two as (select file, symbol, line_start as c0, line_end as c1 from sp where k % 2 = 0 union all select file, 'file:' || file::varchar, min(line_start), max(line_end) from sp group by file)"


def two_spans(ln: DataFrame) -> DataFrame:
    s = spans(ln)
    whole = s.groupBy("file").agg(F.min("line_start").alias("c0"), F.max("line_end").alias("c1")).select("file", F.concat(F.lit("file:"), F.col("file").cast("string")).alias("symbol"), "c0", "c1")
    return s.filter("k % 2 = 0").select("file", "symbol", F.col("line_start").alias("c0"), F.col("line_end").alias("c1")).unionByName(whole)


@query("j08_tightest_span", f"""with {LINES}, {SPANS}, {TWO_SPANS}, p as (select distinct file, line from l where regexp_matches(content, '[0-9]{{3}}')),
r as (select p.file, p.line, symbol, row_number() over (partition by p.file, p.line order by c1 - c0, symbol) as rn from p join two on two.file = p.file and p.line between c0 and c1) select file, line, symbol from r where rn = 1""")
def j08(spark: SparkSession, d: str) -> DataFrame:
    ln = doc_lines(spark, d)
    return I.tightest_span(ln.filter(F.col("content").rlike("[0-9]{3}")).select("file", "line").distinct(), two_spans(ln), "file", "line", "c0", "c1", "symbol")


@query("j09_nearest_chunk", f"""with {LINES}, {SPANS}, n as (select file, symbol, line_start + 2 as line_start, line_end + 3 as line_end from sp), c as (select file, k as chunk_id, line_start as c0, line_end as c1 from sp where k % 3 = 0),
hit as (select n.*, chunk_id, row_number() over (partition by n.file, n.symbol order by abs(c0 - n.line_start), chunk_id) as rn from n join c on c.file = n.file and c0 <= n.line_end and c1 >= n.line_start),
f as (select file, min(chunk_id) as chunk_id from c group by file)
select n.file, n.symbol, n.line_start, n.line_end, coalesce(hit.chunk_id, f.chunk_id) as chunk_id, hit.chunk_id is not null as overlaps from n left join hit on hit.file = n.file and hit.symbol = n.symbol and rn = 1 left join f on f.file = n.file""")
def j09(spark: SparkSession, d: str) -> DataFrame:
    s = spans(doc_lines(spark, d))
    n = s.select("file", "symbol", (F.col("line_start") + 2).alias("line_start"), (F.col("line_end") + 3).alias("line_end"))
    return I.nearest_chunk(n, s.filter("k % 3 = 0").select("file", F.col("k").alias("chunk_id"), F.col("line_start").alias("c0"), F.col("line_end").alias("c1")))


EV = "e as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as prev, row_number() over (partition by user_id order by ts, event_id) as rn, count(*) over (partition by user_id) as cnt from events)"


@query("w01_consecutive_dedup", f"""with {EV}, c as (select *, sum(case when rn > 1 and prev is not distinct from event_type then 0 else 1 end) over (partition by user_id order by ts, event_id) as island from e)
select user_id, island::bigint as island, case when count(*) > 1 then any_value(event_type) || ' (×' || count(*)::varchar || ')' else any_value(event_type) end as label, count(*) as n from c group by user_id, island""")
def w01(spark: SparkSession, d: str) -> DataFrame:
    g = I.islands(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return g.select("user_id", F.col("island").cast("long").alias("island"), I.collapsed_label(F.col("event_type"), F.col("n")).alias("label"), "n")


@query("w02_head_tail", f"with {EV} select user_id, event_id, rn::bigint as rn, (case when cnt > 60 then cnt - 50 else 0 end)::bigint as omitted from e where cnt <= 60 or rn <= 20 or rn > cnt - 30")
def w02(spark: SparkSession, d: str) -> DataFrame:
    got = I.head_tail(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 20, 30, 60)
    return got.select("user_id", "event_id", F.col("rn").cast("long").alias("rn"), F.col("omitted").cast("long").alias("omitted"))


@query("w03_last_n", "select user_id, event_id, rn::bigint as rn from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn <= 50")
def w03(spark: SparkSession, d: str) -> DataFrame:
    got = I.last_n(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 50)
    return got.select("user_id", "event_id", F.col("rn").cast("long").alias("rn"))


@query("w05_transitions", f"with {EV} select user_id, event_id, event_type, prev as previous from e where rn = 1 or prev is distinct from event_type")
def w05(spark: SparkSession, d: str) -> DataFrame:
    return I.transitions(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type").drop("ts")


@query("w06_last_event", "select user_id, arg_max(event_type, (ts, event_id)) as last_type, max(event_id) as last_id from events group by user_id")
def w06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("event_id").alias("last_id"))


@query("w08_per_group_cap", "select source, doc_id, rn::bigint as rn from (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as rn from documents) where rn <= 5")
def w08(spark: SparkSession, d: str) -> DataFrame:
    got = I.last_n(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 5)
    return got.select("source", "doc_id", F.col("rn").cast("long").alias("rn"))


@query("w09_context_window", f"with {LINES} select file, line, md5(string_agg(content, chr(10)) over (partition by file order by line rows between 3 preceding and 3 following)) as around from l")
def w09(spark: SparkSession, d: str) -> DataFrame:
    return I.context(doc_lines(spark, d), "file", "line", "content").select("file", "line", F.md5("around").alias("around"))


@query("w10_forward_fill", f"with {LINES} select file, line, last_value(case when regexp_matches(content, '[0-9]{{3}}') then line end ignore nulls) over (partition by file order by line rows between unbounded preceding and current row) as header from l")
def w10(spark: SparkSession, d: str) -> DataFrame:
    return I.forward_fill(doc_lines(spark, d), "file", "line", F.when(F.col("content").rlike("[0-9]{3}"), F.col("line")), "header").select("file", "line", "header")


@query("w13_first_occurrence", "select word, min(doc_id) as first_doc from (select doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '[\\s]+', ' ', 'g'), ' ')) as word from documents) where length(word) > 0 group by word".replace("\\\\s", "\\s"))
def w13(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s]+", " "), " ")).alias("word"))
    return w.filter(F.length("word") > 0).groupBy("word").agg(F.min("doc_id").alias("first_doc"))


@query("st05_debounce", """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as session from g)
select user_id, session::bigint as session, min(ts) as start, max(ts) as "end", count(*) as n from s group by user_id, session""")
def st05(spark: SparkSession, d: str) -> DataFrame:
    g = I.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", ["event_id"], 1800)
    return g.select("user_id", F.col("session").cast("long").alias("session"), F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


AS_OF, DAYS = "2024-01-25 00:00:00", 14
EVENTS_SQL = f"ev as (select *, value as original, value / 2 as filtered, case when value > 0 then 50.0 + user_id % 10 else 0.0 end as pct, 'u' || (user_id % 12)::varchar as project from events where ts >= timestamp '{AS_OF}' - interval {DAYS} day)"
SAVED = "count(*) as operations, round(coalesce(avg(pct), 0), 6) as avg_pct, round(coalesce(sum(original - filtered), 0), 4) as lines_saved"


def saved(spark: SparkSession, d: str) -> DataFrame:
    e = M.recent(table(spark, d, "events"), "ts", AS_OF, DAYS)
    return e.withColumn("original", F.col("value")).withColumn("filtered", F.col("value") / 2).withColumn("pct", F.when(F.col("value") > 0, 50.0 + F.col("user_id") % 10).otherwise(0.0)).withColumn("project", F.concat(F.lit("u"), (F.col("user_id") % 12).cast("string")))


@query("a01_stats_total", f"with {EVENTS_SQL} select {SAVED} from ev where event_type <> 'signup' and project not like 'u1%'")
def a01(spark: SparkSession, d: str) -> DataFrame:
    return M.savings(saved(spark, d).filter("event_type <> 'signup' and project not like 'u1%'"), F.col("original"), F.col("filtered"), F.col("pct"))


@query("a02_stats_by_project", f"with {EVENTS_SQL} select project, {SAVED} from ev group by project")
def a02(spark: SparkSession, d: str) -> DataFrame:
    return M.savings(saved(spark, d), F.col("original"), F.col("filtered"), F.col("pct"), "project")


@query("a03_stats_by_operation", f"with {EVENTS_SQL} select event_type, {SAVED} from ev group by event_type")
def a03(spark: SparkSession, d: str) -> DataFrame:
    return M.savings(saved(spark, d), F.col("original"), F.col("filtered"), F.col("pct"), "event_type")


@query("a04_dashboard", f"with {EVENTS_SQL}, s as (select event_type, floor(sum(original - filtered))::bigint as ls from ev group by event_type) select event_type, ls * 8 as tokens, round(ls * 8 * 3 / 1000000, 6) as cost from s")
def a04(spark: SparkSession, d: str) -> DataFrame:
    g = saved(spark, d).groupBy("event_type").agg(F.floor(F.sum(F.col("original") - F.col("filtered"))).alias("ls"))
    return g.select("event_type", *M.dashboard(F.col("ls")))


@query("a07_max_per_file", "select l_partkey, max(l_shipdate) as latest, min(l_orderkey) as first_order from lineitem group by l_partkey")
def a07(spark: SparkSession, d: str) -> DataFrame:
    return U.latest_per(table(spark, d, "lineitem"), "l_partkey", "l_shipdate", "l_orderkey").withColumnRenamed("first", "first_order")


@query("a08_community_sizes", "select label, size, (row_number() over (order by size desc, label) - 1)::bigint as community from (select label, count(*) as size from embeddings group by label)")
def a08(spark: SparkSession, d: str) -> DataFrame:
    from loamline.operators import graph as G

    return G.community_sizes(table(spark, d, "embeddings"), "label").select("label", "size", F.col("community").cast("long").alias("community"))


@query("a12_layer_distribution", "select p_type as layer, count(*) as n, round(sum(p_size), 4)::double as weight, round(100.0 * count(*) / (select count(*) from part), 6) as pct from part group by p_type")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return M.distribution(table(spark, d, "part").withColumnRenamed("p_type", "layer"), "layer", F.col("p_size").cast("double"))


@query("a13_layer_share", "select p_type, p_brand, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (partition by p_type), 6) as pct from part group by p_type, p_brand")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return U.share_within(table(spark, d, "part"), "p_type", "p_brand")


MODS = """m as (select s_suppkey as path, case s_nationkey % 4 when 0 then 'rust' when 1 then 'dart' else 'python' end as language, case when s_nationkey % 3 = 0 then 'controller' when s_nationkey % 3 = 1 then 'service' when s_suppkey % 19 = 0 then 'test' else 'repository' end as layer, count(*) * 2 as loc, count(distinct l_partkey) % 50 as function_count, count(distinct l_orderkey) % 30 as fan_out, (s_suppkey % 17 = 0) as is_hub, (s_suppkey % 23 = 0) as has_macros from supplier join lineitem on l_suppkey = s_suppkey group by s_suppkey, s_nationkey),
i as (select distinct l_suppkey as src, (l_partkey % (select count(*) from supplier)) as dst from lineitem)"""


#: Rows of a table that a task holds at once while it looks for distinct ones.
DEALT = 1 << 18


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Distinct rows of the keys, with how many there are of each (n): dealt by them to as many tasks as n rows want."""
    return df.select(*keys).repartition(1 + n // DEALT, *keys).groupBy(*keys).agg(F.count("*").alias("n"))


def modules(spark: SparkSession, d: str, pairs: DataFrame | None = None) -> DataFrame:
    """Modules with their figures; pairs: their imports (l_suppkey, l_partkey, n), if they are written already."""
    rows = table(spark, d, "lineitem")
    n = rows.count()
    pairs = dealt(rows, n, "l_suppkey", "l_partkey") if pairs is None else pairs
    parts = pairs.groupBy("l_suppkey").agg((F.sum("n") * 2).alias("loc"), (F.count("l_partkey") % 50).alias("function_count"))
    orders = dealt(rows, n, "l_suppkey", "l_orderkey").groupBy("l_suppkey").agg((F.count("l_orderkey") % 30).alias("fan_out"))
    li = parts.join(orders, "l_suppkey")
    s = table(spark, d, "supplier").selectExpr("s_suppkey as path", "case s_nationkey % 4 when 0 then 'rust' when 1 then 'dart' else 'python' end as language", "case when s_nationkey % 3 = 0 then 'controller' when s_nationkey % 3 = 1 then 'service' when s_suppkey % 19 = 0 then 'test' else 'repository' end as layer", "s_suppkey % 17 = 0 as is_hub", "s_suppkey % 23 = 0 as has_macros")
    return s.join(li, s["path"] == li["l_suppkey"]).drop("l_suppkey")


def imports(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "supplier").count()
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % n).alias("dst")).distinct()


@query("a14_antipatterns", f"""with {MODS}, t as (select *, case language when 'dart' then 800 when 'rust' then 600 else 500 end as l0, case language when 'dart' then 1500 when 'rust' then 1200 else 1000 end as l1, case language when 'dart' then 25 when 'rust' then 20 else 15 end as f0, case language when 'dart' then 40 when 'rust' then 35 else 25 end as f1 from m)
select path, 'god_class' as kind, case when loc > l1 or (not has_macros and function_count > f1) then 'high' else 'medium' end as severity from t where layer <> 'test' and not is_hub and (loc > l0 or (not has_macros and function_count > f0))
union all select path, 'fat_controller', case when loc > 400 then 'high' else 'medium' end from m where layer = 'controller' and loc > 200
union all select src, 'fat_controller', 'medium' from (select distinct i.src, i.dst from i join m a on a.path = i.src and a.layer = 'controller' join m b on b.path = i.dst and b.layer = 'repository')
union all select path, 'excessive_coupling', case when fan_out > 20 then 'high' else 'medium' end from m where fan_out > 10
union all select path, 'no_service_layer', 'medium' from m where layer = 'controller' and (select count(*) from m) > 5 and not exists (select 1 from m where layer = 'service')
union all select path, 'circular_dependency', 'high' from m where path in (select x.src from i x join i y on x.src = y.dst and x.dst = y.src where x.src <> x.dst)""")
def a14(spark: SparkSession, d: str) -> DataFrame:
    """Pairs and modules are written once; both directions of an import meet under one key, without a join."""
    rows = table(spark, d, "lineitem")
    n = rows.count()
    pairs = cut(dealt(rows, n, "l_suppkey", "l_partkey"))
    m = cut(modules(spark, d, pairs))
    i = pairs.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % table(spark, d, "supplier").count()).alias("dst"))
    ends = i.filter("src <> dst").select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), (F.col("src") < F.col("dst")).alias("up"))
    both = ends.repartition(1 + n // DEALT, "lo", "hi").groupBy("lo", "hi").agg(F.min("up").alias("all_up"), F.max("up").alias("any_up")).filter("any_up and not all_up")
    mutual = both.select(F.explode(F.array("lo", "hi")).alias("node")).distinct().join(m.select(F.col("path").alias("node")), "node", "left_semi")
    return M.antipatterns(m, i, mutual)


@query("j38_layer_violations", f"""with {MODS} select distinct i.src, i.dst, a.layer as from_layer, b.layer as to_layer from i join m a on a.path = i.src join m b on b.path = i.dst where (a.layer = 'controller' and b.layer = 'repository') or (a.layer = 'service' and b.layer = 'controller')""")
def j38(spark: SparkSession, d: str) -> DataFrame:
    return M.layer_violations(modules(spark, d), imports(spark, d), [("controller", "repository"), ("service", "controller")])


MONTHS = "mo as (select o_orderpriority as service, date_trunc('month', o_orderdate)::timestamp as ts, count(*) as n, round(sum(o_totalprice) * 100)::bigint as cents from orders group by 1, 2)"


def months(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("service"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice") * 100).cast("long").alias("cents"))


@query("j26_snapshot_compare", f"with {MONTHS} select service, ts, n, cents, n - lag(n) over w as d_n, cents - lag(cents) over w as d_cents from mo window w as (partition by service order by ts)")
def j26(spark: SparkSession, d: str) -> DataFrame:
    return M.compare_snapshots(months(spark, d), "service", "ts", ["n", "cents"])


@query("w12_last_two", f"with {MONTHS}, r as (select *, row_number() over (partition by service order by ts desc) as rn from mo) select a.service, a.n as now_n, b.n as before_n from r a left join r b on b.service = a.service and b.rn = 2 where a.rn = 1")
def w12(spark: SparkSession, d: str) -> DataFrame:
    top = I.last_n(months(spark, d), ["service"], [F.desc("ts")], 2)
    return top.groupBy("service").agg(F.max(F.when(F.col("rn") == 1, F.col("n"))).alias("now_n"), F.max(F.when(F.col("rn") == 2, F.col("n"))).alias("before_n"))


for _unit, _fmt in (("day", "%Y-%m-%d"), ("week", "%G-W%V"), ("month", "%Y-%m"), ("year", "%Y")):

    def _timeline(spark: SparkSession, d: str, unit: str = _unit) -> DataFrame:
        o = table(spark, d, "orders")
        return o.groupBy(M.period(F.col("o_orderdate"), unit).alias("period")).agg(F.count("*").alias("commits"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))

    query(f"a30_timeline_{_unit}", f"select strftime(o_orderdate, '{_fmt}') as period, count(*) as commits, min(o_orderkey) as first_key, max(o_orderkey) as last_key from orders group by 1")(_timeline)


@query("a30_timeline_type", "select lower(split_part(o_orderpriority, '-', 2)) as ctype, o_orderstatus as scope, count(*) as commits from orders group by 1, 2")
def a30t(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("ctype"), F.col("o_orderstatus").alias("scope")).agg(F.count("*").alias("commits"))


@query("a31_dominant_scope", """with g as (select l_orderkey as key, p_brand as brand, sum(l_quantity) as w from lineitem join part on p_partkey = l_partkey group by 1, 2), b as (select key, max(w) as w, sum(w) as total from g group by key)
select g.key, min(brand) as brand, round(max(g.w / total), 6) as share from g join b on b.key = g.key and b.w = g.w group by g.key having max(g.w / total) >= 0.5""")
def a31(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("key"), F.col("p_brand").alias("brand"), "l_quantity")
    return M.dominant(rows, "key", "brand", F.col("l_quantity"))


@query("a32_shape_flags", "select l_orderkey, bool_and(l_returnflag = 'R') as all_returned, bool_or(l_returnflag = 'R') as any_returned, bool_and(l_linestatus = 'F') as all_final from lineitem group by l_orderkey")
def a32(spark: SparkSession, d: str) -> DataFrame:
    returned, final = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    return U.shape_flags(table(spark, d, "lineitem"), "l_orderkey", {"all_returned": ("all", returned), "any_returned": ("any", returned), "all_final": ("all", final)})


@query("a33_review_totals", "select l_returnflag, count(*) as hunks, count(distinct l_partkey) as symbols, round(sum(l_quantity), 2) as added, list_sort(list(distinct l_linestatus)) as kinds from lineitem group by l_returnflag")
def a33(spark: SparkSession, d: str) -> DataFrame:
    return U.review_totals(table(spark, d, "lineitem"), "l_returnflag", "l_partkey", "l_quantity", "l_linestatus")


@query("a20_coverage_totals", "select l_suppkey, count(*) as lines, sum((l_discount > 0.05)::int)::bigint as hit, round(case when count(*) > 0 then 100.0 * sum((l_discount > 0.05)::int) / count(*) else 0 end, 6) as pct from lineitem group by l_suppkey")
def a20(spark: SparkSession, d: str) -> DataFrame:
    return U.coverage_by(table(spark, d, "lineitem"), "l_suppkey", F.col("l_discount") > 0.05)


@query("t10_hot_symbols", "with recursive " + "x as (select l_partkey as part, count(*) as calls from lineitem group by 1) select part, calls from x order by calls desc, part limit 5")
def t10(spark: SparkSession, d: str) -> DataFrame:
    return U.most_frequent(table(spark, d, "lineitem").withColumnRenamed("l_partkey", "part"), "part", 5, "calls")


@query("a26_language_mix", "select lang, count(*) as n from documents group by lang order by n desc, lang limit 3")
def a26(spark: SparkSession, d: str) -> DataFrame:
    return U.most_frequent(table(spark, d, "documents"), "lang", 3)


@query("a27_index_lines", f"with {LINES}, f as (select file, max(line) as loc, count(*) filter (where length(trim(content)) > 0) as filled from l group by file) select count(*) as files, sum(loc)::bigint as loc, sum(filled)::bigint as filled from f")
def a27(spark: SparkSession, d: str) -> DataFrame:
    f = doc_lines(spark, d).groupBy("file").agg(F.max("line").alias("loc"), F.count(F.when(F.length(F.trim("content")) > 0, 1)).alias("filled"))
    return f.agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.sum("filled").alias("filled"))


@query("j36_local_resolution", CTE + """ select source_qualified, target_qualified as name, coalesce(r, target_qualified) as target from e left join (select file_path, name, min(qualified_name) as r from n group by 1, 2) f on f.file_path = e.file_path and f.name = e.target_qualified where not contains(target_qualified, '::')""")
def j36(spark: SparkSession, d: str) -> DataFrame:
    """Bare calls resolved to the first symbol of their name in the same file."""
    n, e = call_graph(spark, d)
    first = n.groupBy("file_path", "name").agg(F.min("qualified_name").alias("resolved"))
    bare = e.filter("instr(target_qualified, '::') = 0").withColumnRenamed("target_qualified", "name")
    return bare.join(first, ["file_path", "name"], "left").select("source_qualified", "name", F.coalesce("resolved", "name").alias("target"))


@query("st02_latest_state", "select user_id, arg_max(event_type, (ts, event_id)) as last_line, arg_max(value, (ts, event_id)) as last_value from events group by user_id")
def st02(spark: SparkSession, d: str) -> DataFrame:
    from loamline.streaming.logs import latest_by_stream

    return latest_by_stream(spark, d)
