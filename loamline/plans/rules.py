"""Queries over the tables, third part: findings, contracts, drift and incremental state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.operators import audit as A
from loamline.operators import contracts as C
from loamline.operators import incremental as N
from loamline.operators import lookups as U
from loamline.operators import metrics as M
from loamline.plans.basics import TOK, table
from loamline.plans.lines_and_time import LINES, doc_lines
from loamline.plans.registry import query

RULES = A.SECRET_RULES + A.CODE_RULES


def _sql(text: str) -> str:
    return text.replace("'", "''")


def findings_sql(rules: tuple[A.Rule, ...] = RULES) -> str:
    one = []
    for r in rules:
        unless = f" and not regexp_matches(content, '{_sql(r.unless)}')" if r.unless else ""
        one.append(f"select file, line, '{r.id}' as rule, '{r.category}' as category, '{r.severity}' as severity from l where regexp_matches(content, '{_sql(r.pattern)}'){unless}")
    return "f as (" + " union all ".join(one) + ")"


FINDINGS = f"with {LINES}, {findings_sql()}"


def found(spark: SparkSession, d: str) -> DataFrame:
    return A.findings(A.near_lines(table(spark, d, "documents"), "doc_id", "text", RULES), RULES)


@query("audit_findings", FINDINGS + " select * from f")
def audit_findings(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d)


@query("audit_suppressed", FINDINGS + """ select f.* from f join documents on doc_id = file where not ((regexp_matches(rule, '^secret-[^/]*$') or regexp_matches(category, '^secret-[^/]*$')) and regexp_matches(source, '^src1[^/]*$'))
 and not ((regexp_matches(rule, '^PersonalData$') or regexp_matches(category, '^PersonalData$')) and regexp_matches(source, '^.*[^/]*2$'))
 and file not in (select file from l where line <= 5 and contains(content, 'lint:ignore-file')) and not exists (select 1 from l where l.file = f.file and l.line = f.line - 1 and contains(l.content, 'lint:ignore-next-line'))""")
def audit_suppressed(spark: SparkSession, d: str) -> DataFrame:
    f = found(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("file"), "source"), "file")
    return A.suppress(f, doc_lines(spark, d), [("secret-*", "src1*"), ("PersonalData", "***2")], F.col("source")).drop("source")


ADJUSTED = """, g as (select f.*, case when d.lang = 'de' then 'generated' when d.lang = 'es' then 'i18n' else 'core' end as role, d.source like '%7' as is_test, d.source like '%3' as is_const from f join documents d on d.doc_id = f.file),
a as (select *, case when category = 'UnsafeErrorHandling' and (is_const or is_test) then 'info' when category = 'HardcodedSecret' and is_test then 'low' when category = 'WeakCryptography' and role = 'i18n' then 'info' when role = 'generated' then 'info' else severity end as adjusted,
 case when category = 'UnsafeErrorHandling' and (is_const or is_test) then 'certain' when category = 'HardcodedSecret' and is_test then 'probable' when category = 'WeakCryptography' and role = 'i18n' then 'certain' when role = 'generated' then 'certain' else 'heuristic' end as confidence from g)"""


def adjusted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.when(F.col("lang") == "de", "generated").when(F.col("lang") == "es", "i18n").otherwise("core").alias("role"), F.col("source").like("%7").alias("is_test"), F.col("source").like("%3").alias("is_const"))
    f = found(spark, d).join(docs, "file")
    sev, conf = A.in_context(F.col("severity"), F.col("category"), F.col("role"), F.col("is_test"), F.col("is_const"))
    return f.withColumn("adjusted", sev).withColumn("confidence", conf)


SUMMARY = ", ".join(f"coalesce(sum((adjusted = '{s}')::int), 0)::bigint as {s}" for s in M.SEVERITIES)


@query("a17_severity_summary", FINDINGS + ADJUSTED + f" select {SUMMARY} from a")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return M.severity_summary(adjusted(spark, d), "adjusted")


RISK = "case " + " ".join(f"when adjusted = '{s}' and confidence = '{c}' then {v}" for s, by in M.RISK.items() for c, v in zip(M.CONFIDENCES, by, strict=True)) + " else 0 end"


@query("a18_risk_score", FINDINGS + ADJUSTED + f" select least(100, coalesce(sum({RISK}), 0))::bigint as risk from a")
def a18(spark: SparkSession, d: str) -> DataFrame:
    return M.risk_score(adjusted(spark, d), "adjusted", "confidence")


@query("a18_risk_by_source", FINDINGS + ADJUSTED + f" select source, least(100, sum({RISK}))::bigint as risk, count(*) as n from a join documents on doc_id = file group by source")
def a18s(spark: SparkSession, d: str) -> DataFrame:
    w = F.lit(0)
    for s, by in M.RISK.items():
        for c, v in zip(M.CONFIDENCES, by, strict=True):
            w = F.when((F.col("adjusted") == s) & (F.col("confidence") == c), v).otherwise(w)
    f = adjusted(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("file"), "source"), "file")
    return f.groupBy("source").agg(F.least(F.lit(100), F.sum(w)).cast("long").alias("risk"), F.count("*").alias("n"))


@query("a19_quality_score", FINDINGS + """, t as (select distinct source as tool from documents), s as (select source as tool, sum(case severity when 'critical' then 5.0 when 'high' then 2.0 else 0.5 end) as lost from f join documents on doc_id = file group by 1)
select t.tool, greatest(0.0, 100.0 - coalesce(lost, 0.0))::double as score from t left join s on s.tool = t.tool""")
def a19(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("source").alias("tool"))
    sev = F.when(F.col("severity") == "critical", "important").when(F.col("severity") == "high", "warning").otherwise("suggestion")
    return M.quality_score(found(spark, d).join(docs, "file").withColumn("severity", sev), docs.select("tool").distinct())


@query("st06_log_filter", f"""with {LINES}, s as (select file, line, regexp_replace(content, '\\x1b\\[[0-9;?]*[A-Za-z]', '', 'g') as c from l), p as (select * from s where not (regexp_matches(c, '^\\s*\\d{{1,3}}(\\.\\d+)?%\\s*$') or regexp_matches(c, '^\\s*\\[[=#>. -]+\\]') or regexp_matches(c, '^\\s*[|/\\\\-]\\s*$') or regexp_matches(c, '^[\\s█▓▒░▏▎▍▌▋▊▉=>#.-]{{5,}}$'))),
q as (select *, lag(c) over (partition by file order by line) as prev from p) select file, line, md5(c) as digest from q where prev is null or prev <> c""".replace("\\\\-]", "\\-]").replace("\\x1b", "\x1b"))
def st06(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    s = doc_lines(spark, d).select("file", "line", A.strip_ansi(F.col("content")).alias("c"))
    prev = F.lag("c").over(Window.partitionBy("file").orderBy("line"))
    return s.filter(~A.is_progress(F.col("c"))).withColumn("prev", prev).filter("prev is null or prev <> c").select("file", "line", F.md5("c").alias("digest"))


PATHS = r"""u as (select page_id, case when p = '' then '/' else p end as key, regexp_extract(lower(url), '^[a-z]+://([^/:?#]*)', 1) as host from (select page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/+$', ''), '/(\d+)(/|$)', '/{param}\2', 'g') as p from pages))"""


def contract_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", C.rest_path(F.col("url")).alias("key"), C.url_host(F.col("url")).alias("host"))


@query("rest_paths", f"with {PATHS} select page_id, key, host from u")
def rest_paths(spark: SparkSession, d: str) -> DataFrame:
    return contract_keys(spark, d)


SIDES = f"with {PATHS}, v as (select page_id, page_id % 40 as svc, regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '[?#].*$', '') as key from pages), p as (select distinct key, svc as producer from v where page_id % 2 = 0 or page_id % 3 = 0), c as (select distinct key, svc as consumer from v where page_id % 2 = 1)"


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "pages").select("page_id", (F.col("page_id") % 40).alias("svc"), F.regexp_replace(F.regexp_replace(F.lower("url"), "^[a-z]+://", ""), "[?#].*$", "").alias("key"))
    return v.filter("page_id % 2 = 0 or page_id % 3 = 0").select("key", F.col("svc").alias("producer")).distinct(), v.filter("page_id % 2 = 1").select("key", F.col("svc").alias("consumer")).distinct()


@query("j15_contract_exact", SIDES + " select distinct key, producer, consumer from c join p using (key)")
def j15(spark: SparkSession, d: str) -> DataFrame:
    p, c = sides(spark, d)
    return C.exact_links(p, c)


PARAMS = SIDES + r""", a as (select distinct key as producer_key, string_split(key, '/') as s from (select '/' || split_part(key, '/', 2) || '/{param}' as key from p) x), b as (select distinct key as consumer_key, string_split(key, '/') as s from (select '/' || split_part(key, '/', 2) || '/' || split_part(key, '/', 3) as key from c) y)"""


@query("j16_contract_param", PARAMS + """ select producer_key, consumer_key from a join b on len(a.s) = len(b.s) where producer_key <> consumer_key
 and len(list_filter(list_zip(a.s, b.s), lambda z: not (z[1] = z[2] or z[1] = '{param}' or z[2] = '{param}'))) = 0 and len(list_filter(list_zip(a.s, b.s), lambda z: z[1] = z[2] and z[1] <> '' and z[1] <> '{param}')) > 0""")
def j16(spark: SparkSession, d: str) -> DataFrame:
    p, c = sides(spark, d)
    part = lambda i: F.split_part("key", F.lit("/"), F.lit(i))
    a = p.select(F.concat(F.lit("/"), part(2), F.lit("/{param}")).alias("key"))
    b = c.select(F.concat(F.lit("/"), part(2), F.lit("/"), part(3)).alias("key"))
    return C.param_links(a, b)


@query("j17_contract_drift", SIDES + """ select distinct c.key, case when c.key in (select key from p) then 'matched' when split_part(c.key, '/', 1) in (select split_part(key, '/', 1) from p) then 'violation' else 'external' end as status from c""")
def j17(spark: SparkSession, d: str) -> DataFrame:
    p, c = sides(spark, d)
    return C.drift(p, c, F.split_part("key", F.lit("/"), F.lit(1)))


DEPS = f"with t as (select doc_id, source, unnest(regexp_extract_all(text, '{TOK}')) as w from documents), dp as (select distinct source as project, w as dependency from t where length(w) >= 14), pk as (select distinct 's' || (item_id % 5)::varchar as project, w as package from (select item_id, unnest(regexp_extract_all(text, '{TOK}')) as w from benchmark) where length(w) >= 14)"


def deps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tok = lambda df, *cols: df.select(*cols, F.explode(F.regexp_extract_all("text", F.lit(f"({TOK})"), F.lit(1))).alias("w")).filter(F.length("w") >= 14)
    dp = tok(table(spark, d, "documents"), F.col("source").alias("project")).select("project", F.col("w").alias("dependency")).distinct()
    pk = tok(table(spark, d, "benchmark"), F.concat(F.lit("s"), (F.col("item_id") % 5).cast("string")).alias("project")).select("project", F.col("w").alias("package")).distinct()
    return dp, pk


@query("j18_cross_project", DEPS + " select distinct dp.project, dependency, pk.project as target from dp join pk on replace(lower(dependency), '_', '-') = replace(lower(package), '_', '-') and dp.project <> pk.project")
def j18(spark: SparkSession, d: str) -> DataFrame:
    return C.cross_project(*deps(spark, d))


@query("set2_unmatched", DEPS + " select distinct dependency from dp where replace(lower(dependency), '_', '-') not in (select replace(lower(package), '_', '-') from pk)")
def set2(spark: SparkSession, d: str) -> DataFrame:
    return C.unmatched(*deps(spark, d))


@query("set3_shared_words", DEPS + " select dependency as word from dp intersect select package from pk")
def set3(spark: SparkSession, d: str) -> DataFrame:
    dp, pk = deps(spark, d)
    return dp.select(F.col("dependency").alias("word")).intersect(pk.select("package"))


FIELDS = [("lineitem", "order_key"), ("lineitem", "part_key"), ("lineitem", "supplier_key"), ("lineitem", "tax"), ("orders", "customerId"), ("customer", "nation_id"), ("nation", "region_id"), ("supplier", "nation_id"), ("nation", "nation_id")]
MODELS = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


@query("j27_sync_merge", """with m as (select distinct substr(sha256(lang || '|' || coalesce(text, '')), 1, 8) as hash from documents where doc_id % 2 = 0), t as (select distinct substr(sha256(lang || '|' || coalesce(text, '')), 1, 8) as hash from documents where doc_id % 3 = 0)
select coalesce(m.hash, t.hash) as hash, case when t.hash is null then 'insert' when m.hash is null then 'resolve' else 'unchanged' end as action from m full join t on m.hash = t.hash""")
def j27(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").withColumn("hash", F.substring(F.sha2(F.concat("lang", F.lit("|"), F.coalesce("text", F.lit(""))), 256), 1, 8))
    return N.sync(x.filter("doc_id % 2 = 0"), x.filter("doc_id % 3 = 0"))


STATE = "w as (select doc_id, sha256(coalesce(text, '')) as digest from documents), s as (select doc_id, case when doc_id % 13 = 0 then 'x' || digest else digest end as digest from w where doc_id % 17 <> 0 union all select doc_id + 100000000, digest from w where doc_id % 29 = 0)"


def states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    s = w.filter("doc_id % 17 <> 0").withColumn("digest", F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("x"), "digest")).otherwise(F.col("digest")))
    return w, s.unionByName(w.filter("doc_id % 29 = 0").withColumn("doc_id", F.col("doc_id") + 100000000))


@query("r18_incremental", f"with {STATE} select coalesce(w.doc_id, s.doc_id) as doc_id, case when s.doc_id is null then 'added' when w.doc_id is null then 'gone' when w.digest = s.digest then 'unchanged' else 'changed' end as status from w full join s on w.doc_id = s.doc_id")
def r18(spark: SparkSession, d: str) -> DataFrame:
    return N.changes(*states(spark, d), "doc_id", "digest")


@query("j28_stale_files", f"with {STATE} select doc_id from s where doc_id not in (select doc_id from w)")
def j28(spark: SparkSession, d: str) -> DataFrame:
    w, s = states(spark, d)
    return U.gone_files(s, w, "doc_id")


@query("j29_dependents", "with i as (select distinct l_suppkey as src, l_partkey as dst from lineitem), c as (select p_partkey from part where p_size = 3) select distinct src as path from i where dst in (select p_partkey from c) and src not in (select p_partkey from c)")
def j29(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return N.dependents(i, table(spark, d, "part").filter("p_size = 3").select(F.col("p_partkey").alias("path")))


ENV = f"with a as (select distinct unnest(regexp_extract_all(text, '{TOK}')) as name from documents), b as (select distinct unnest(regexp_extract_all(text, '{TOK}')) as name from benchmark)"


@query("j33_env_drift", ENV + " select name, 'undocumented' as status from a where name not in (select name from b) union all select name, 'dead' from b where name not in (select name from a)")
def j33(spark: SparkSession, d: str) -> DataFrame:
    tok = lambda n: table(spark, d, n).select(F.explode(F.regexp_extract_all("text", F.lit(f"({TOK})"), F.lit(1))).alias("name")).distinct()
    return U.env_drift(tok("documents"), tok("benchmark"), "name")


@query("j31_token_demotion", f"""with t as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{TOK}')) as w from documents), g as (select w, count(*) as n from t group by w), b as (select distinct unnest(regexp_extract_all(text, '{TOK}')) as w from benchmark)
select b.w, coalesce(n, 0)::bigint as n, case when coalesce(n, 0) > 1 then 'uncertain' else 'dead' end as confidence from b left join g on g.w = b.w""")
def j31(spark: SparkSession, d: str) -> DataFrame:
    tok = lambda n: table(spark, d, n).select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({TOK})"), F.lit(1))).alias("w"))
    g = tok("documents").groupBy("w").agg(F.count("*").alias("n"))
    return U.demoted(tok("benchmark").distinct(), g, "w")


@query("a24_token_tally", f"select w, count(*) as n, count(distinct doc_id) as docs from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{TOK}')) as w from documents) group by w")
def a24(spark: SparkSession, d: str) -> DataFrame:
    # Counted within a document first: a word in a third of all rows is one row a document.
    t = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({TOK})"), F.lit(1))).alias("w"))
    one = t.groupBy("w", "doc_id").agg(F.count("*").alias("c"))
    return one.groupBy("w").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


@query("j21_outer_fill", """select coalesce(d.doc_id, l.doc_id) as doc_id, coalesce(d.lang, 'unknown') as lang, coalesce(d.q, l.quality) as q from (select doc_id, lang, null::int as q from documents where doc_id % 2 = 0) d full join labels l on l.doc_id = d.doc_id""")
def j21(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "documents").filter("doc_id % 2 = 0").select("doc_id", "lang", F.lit(None).cast("int").alias("q"))
    right = table(spark, d, "labels").select("doc_id", F.lit("unknown").alias("lang"), F.col("quality").alias("q"))
    return C.full_outer_fill(left, right, ["doc_id"], ["lang", "q"])


@query("t09_nulls_first", "select label, count(*) as n from (select case when label = 3 then null else label end as label from embeddings) group by label order by label nulls first")
def t09(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.when(F.col("label") != 3, F.col("label")).alias("label")).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.asc_nulls_first("label"))
