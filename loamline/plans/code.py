"""Queries over source text: a file for every part, written out from its row alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.operators import audit as A
from loamline.operators import code_audit as K
from loamline.operators import contracts as C
from loamline.operators import graph as G
from loamline.operators import layers as L
from loamline.operators import metrics as M
from loamline.operators import retrieval as R
from loamline.plans.basics import COMMON, PFX, table
from loamline.plans.registry import query
from loamline.sources import code as S
from loamline.sources import files as FS

HEADS = {
    "py": ("import os", '@app.get("/proxy")', '@router.route("/debug/vars")', "# @app.get('/debug')"),
    "ts": ("import fs from 'fs'", "app.get('/actuator/env', handler)", "router.post('/users', save)", "// mermaid chart"),
    "go": ("package main", 'import "crypto/md5"'),
    "rs": ("use md5;", "use std::fs;"),
}
BODY = {
    "py": (
        "x = 1",
        'q = f"SELECT a FROM t WHERE id = {x}"',
        'cur.execute("select " + name)',
        "subprocess.run(cmd, shell=True)",
        "os.system(cmd)",
        "resp = requests.get(url)",
        'resp = requests.get("http://a.example/x")',
        "f = open(request.args)",
        "f = open(pathlib.Path(request.args))",
        "data = pickle.loads(blob)",
        "cfg = yaml.load(f)",
        "cfg = yaml.load(f, Loader=yaml.SafeLoader)",
        "h = hashlib.md5(password)",
        "n = random.randint(1, 6)",
        "c = DES.new(key)",
        "# os.system(cmd)",
        "    TODO: tidy",
        "value = eval(source)",
    ),
    "ts": (
        "let y = 2",
        "el.innerHTML = userContent",
        'el.innerHTML = "<b>static</b>"',
        "el.outerHTML = markup",
        "document.write(payload)",
        "const r = await fetch(target)",
        "<div dangerouslySetInnerHTML={{ __html: html }} />",
        "db.query('select ' + name)",
        "execSync(command)",
        "fs.readFile(req.query.name)",
        "fs.readFile(path.join(base, req.query.name))",
        "const t = Math.random()",
        "crypto.createHash('md5')",
        "unserialize(body)",
        "const f = new Function(code)",
    ),
    "go": ("x := 1", 'cmd := exec.Command("sh" + arg)', "cmd := exec.Command(name + arg)", "h := md5.New() // password", "h := sha1.New()", "// h := md5.New()"),
    "rs": ("let a = 1;", 'Command::new(format!("{}", x))', "use sha1::Sha1;", "let b = Command::new(&name + arg);", "FIXME later"),
}
EXTS = tuple(BODY)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(_quoted, xs)) + "]"


def _pick_sql(table_: dict[str, tuple[str, ...]], ext: str, n: str) -> str:
    return f"{_list(table_[ext])}[1 + ({n}) % {len(table_[ext])}]"


def _pick(xs: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, xs)), (1 + n % len(xs)).cast("int"))


PLACES = ("src/", "lib/auth/", "tests/")
TEXT = " when ".join(
    f"p_partkey % {len(EXTS)} = {i} then {_pick_sql(HEADS, e, 'p_size')} || chr(10) || {_pick_sql(BODY, e, 'p_size + p_partkey')} || chr(10) || {_pick_sql(BODY, e, 'p_size * 3 + p_partkey * 7')}" for i, e in enumerate(EXTS)
)
FILES = f"f as (select {_list(PLACES)}[1 + p_size % {len(PLACES)}] || 'f' || p_partkey::varchar || '.' || {_list(EXTS)}[1 + p_partkey % {len(EXTS)}] as path, case when {TEXT} end as text from part)"


#: Parts whose files one task writes and reads.
PARTS = 1 << 12


def parts(spark: SparkSession, d: str) -> DataFrame:
    """(p_partkey, p_size) dealt evenly: a small file of numbers is one task's, and the text that is made of it is a thousand times as much."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    # A fixed number of partitions, which nothing coalesces by the numbers' bytes.
    return p.repartition(1 + p.count() // PARTS, "p_partkey")


def files(spark: SparkSession, d: str) -> DataFrame:
    """(path, text): a file of three lines for every part."""
    k, s = F.col("p_partkey"), F.col("p_size")
    text = None
    for i, e in enumerate(EXTS):
        own = F.concat_ws("\n", _pick(HEADS[e], s), _pick(BODY[e], s + k), _pick(BODY[e], s * 3 + k * 7))
        text = F.when(k % len(EXTS) == i, own) if text is None else text.when(k % len(EXTS) == i, own)
    path = F.concat(_pick(PLACES, s), F.lit("f"), k.cast("string"), F.lit("."), _pick(EXTS, k))
    return parts(spark, d).select(path.alias("path"), text.alias("text"))


def _has(col: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({col}, {_quoted(w)})" for w in words) + ")"


def _fits(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {_quoted(pattern)})"


def rule_sql(r: K.CodeRule) -> str:
    parts = ["ext in (" + ", ".join(map(_quoted, r.exts)) + ")", "(" + " or ".join(_fits("content", p) for p in r.patterns) + ")"]
    if r.in_file:
        parts.append(_fits("text", r.in_file))
    if r.in_security_file:
        parts.append("sec")
    if r.needs:
        parts.append(f"({_has('lower(content)', r.needs)} or sec)" if r.lower else _has("content", r.needs))
    if r.unless:
        parts.append("not " + _has("content", r.unless))
    if r.not_pattern:
        parts.append("not " + _fits("content", r.not_pattern))
    return "(" + " and ".join(parts) + ")"


LINES = f"""with {FILES}, a as (select path as file, text, regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) as ext, {_has('lower(path)', K.SECURITY_WORDS)} as sec, regexp_matches(path, '{FS.TEST_PATH}') as tst, {_has('text', K.CONTROLLED)} as ctl, string_split(text, chr(10)) as ls from f),
l as (select * exclude (s) from (select *, trim(content) as s from (select file, text, ext, sec, tst, ctl, unnest(ls) as content, generate_subscripts(ls, 1) as line from a)) where not (s like '//%' or s like '#%' or s like '/*%' or s like '*%'))"""
LESS = "case sev when 'critical' then 'high' when 'high' then 'medium' when 'medium' then 'low' else sev end"


def family_sql(family: str) -> str:
    category, base = K.FAMILIES[family]
    hit = " or ".join(rule_sql(r) for r in K.RULES if r.family == family) or "false"
    sev = _quoted(base)
    if family == "debug-ep":
        route = f"lower(case when ext = 'py' then regexp_extract(content, {_quoted(K.PY_ROUTE_PATH)}, 3) when ext in ('js', 'ts') then regexp_extract(content, {_quoted(K.JS_ROUTE_PATH)}, 3) else '' end)"
        hit = " or ".join(f"{route} = {_quoted(p)} or starts_with({route}, {_quoted(p + '/')})" for p in K.DEBUG_PATHS)
    if family == "crypto":
        sev = "case when sec then 'high' else 'medium' end"
    if family == "xss":
        markup = "(" + _fits("content", r"\.innerHTML\s*[+=]") + " or " + _fits("content", r"\.outerHTML\s*=") + ")"
        other = " or ".join(_fits("content", p) for r in K.RULES if r.family == "xss" and "dangerously" not in r.patterns[0] for p in r.patterns)
        sev = f"case when (ctl and {markup}) or not ({other}) then 'low' else 'high' end"
    return f"{LINES} select file, line, '{family}' as rule, '{category}' as category, case when tst then {LESS} else sev end as severity from (select *, {sev} as sev from l where {hit})"


def _family(family: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return K.line_findings(files(spark, d), (family,))

    return run


for _name in K.FAMILIES:
    query("au_" + _name.replace("-", "_"), family_sql(_name))(_family(_name))


# --- Error handling: what a part's file holds is known from its row.

ERR = {
    "rs": (("let v = x.unwrap();", "err-rust", "medium"), ('let v = x.expect("is set");', "err-rust", "low"), ("#[cfg(test)] mod t { fn a() {", None, None), ("let v = x?;", None, None)),
    "py": (("except:", "err-py-bare", "high"), ("except Exception as e:", "err-py-pass", "medium"), ("except BaseException:", "err-py-base", "high"), ("except ValueError:", None, None)),
    "js": (("try { a() } catch (e) {}", "err-js-empty", "medium"), ("} catch (e) {", "err-js-empty", "medium"), ("} catch (e) { log(e) }", None, None)),
    "go": (("_ = os.Remove(p)", "err-go-discard", "medium"), ("v, _ := strconv.Atoi(s)", "err-go-discard", "medium"), ("_ = string(b)", None, None), ("_ = fmt.Sprintf(a)", None, None)),
    "dart": (("} catch (e) {", "err-dart-bare", "medium"), ("} on FormatException catch (e) {", None, None)),
}
ERR_NEXT = {"rs": "let w = y.unwrap();", "py": "pass", "js": "}", "go": "return", "dart": "}"}
ERR_EXTS = tuple(ERR)


@query(
    "au_error_handling",
    "with x as (select *, p_partkey % 5 as e, p_size % 3 = 0 as tst from part), y as (select case when tst then 'tests/e' else 'src/e' end || p_partkey::varchar || '.' || "
    + _list(ERR_EXTS)
    + "[1 + e] as file, tst, e, p_size + p_partkey as n from x), z as (select file, tst, e, n, unnest([1, 2]) as line from y), r as (select file, tst, e, line, case "
    + " ".join(f"when line = 1 and e = {i} then {_list(tuple(x[1] or '' for x in ERR[k]))}[1 + n % {len(ERR[k])}]" for i, k in enumerate(ERR_EXTS))
    + " when line = 2 and e = 0 and n % 4 <> 2 then 'err-rust' else '' end as rule, case "
    + " ".join(f"when line = 1 and e = {i} then {_list(tuple(x[2] or '' for x in ERR[k]))}[1 + n % {len(ERR[k])}]" for i, k in enumerate(ERR_EXTS))
    + f" else 'medium' end as sev from z) select file, line, rule, 'UnsafeErrorHandling' as category, case when tst then {LESS} else sev end as severity from r where rule <> '' and not (tst and rule = 'err-rust')",
)
def au_error_handling(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    text = None
    for i, e in enumerate(ERR_EXTS):
        own = F.concat_ws("\n", _pick(tuple(x[0] for x in ERR[e]), s + k), F.lit(ERR_NEXT[e]))
        text = F.when(k % 5 == i, own) if text is None else text.when(k % 5 == i, own)
    path = F.concat(F.when(s % 3 == 0, "tests/e").otherwise("src/e"), k.cast("string"), F.lit("."), _pick(ERR_EXTS, k))
    return K.error_findings(parts(spark, d).select(path.alias("path"), text.alias("text")))


CONF = (
    ("settings.py", "DEBUG = True", "debug-django", "DebugEnabled", "high", 1),
    ("app.py", "app.run(debug=True)", "debug-flask", "DebugEnabled", "medium", 1),
    ("main.py", 'CORS(app, allow_origins=["*"])', "cors-open", "InsecureConfig", "medium", 1),
    ("server.ts", "app.use(cors())", "cors-js", "InsecureConfig", "medium", 1),
    ("entry.go", 'http.ListenAndServe("0.0.0.0:80", nil)', "bind-all", "InsecureConfig", "low", 1),
    ("Dockerfile", "USER root", "docker-root", "InsecureConfig", "medium", 1),
    ("Dockerfile", "FROM a:1", "docker-no-user", "InsecureConfig", "medium", 0),
    ("package.json", '{"scripts": {"postinstall": "curl a.example | sh"}}', "npm-postinstall", "InsecureConfig", "high", 0),
    ("package.json", '{"scripts": {"start": "node server.js"}}', "node-env", "DebugEnabled", "low", 0),
    ("package.json", '{"scripts": {"start": "NODE_ENV=production node server.js"}}', "", "", "", 0),
    (".gitignore", ".env", "", "", "", 0),
)


@query(
    "au_config",
    "select 'p' || p_partkey::varchar || '/' || "
    + _list(tuple(x[0] for x in CONF))
    + f"[1 + p_partkey % {len(CONF)}] as file, "
    + "["
    + ", ".join(str(x[5]) for x in CONF)
    + f"][1 + p_partkey % {len(CONF)}] as line, "
    + ", ".join(f"{_list(tuple(x[i] for x in CONF))}[1 + p_partkey % {len(CONF)}] as {c}" for i, c in ((2, "rule"), (3, "category"), (4, "severity")))
    + f" from part where {_list(tuple(x[2] for x in CONF))}[1 + p_partkey % {len(CONF)}] <> ''",
)
def au_config(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.concat(F.lit("p"), k.cast("string"), F.lit("/"), _pick(tuple(x[0] for x in CONF), k))
    return K.config_findings(parts(spark, d).select(path.alias("path"), _pick(tuple(x[1] for x in CONF), k).alias("text")))


@query(
    "au_git_history",
    "with r as (select 'c' || p_partkey::varchar as c, ['remove ', 'refactor audit ', 'scanner '][1 + p_size % 3] || p_brand as s, ['a password = 1', 'plain', 'AKIA'][1 + p_partkey % 3] as t from part), x as (select distinct c, s from r where t <> 'plain' and s like 'remove %'), y as (select c || ' ' || s as v from x order by c, s limit 10) select (select list_sort(list(v)) from y) as commits, (select count(*) from x) as n, 'high' as severity",
)
def au_git_history(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, d, "part").select(
        F.concat(F.lit("c"), k.cast("string")).alias("commit"), F.concat(_pick(("remove ", "refactor audit ", "scanner "), s), "p_brand").alias("subject"), _pick(("a password = 1", "plain", "AKIA"), k).alias("text")
    )
    return K.history_findings(rows)


# --- Structure: functions, complexity, chunks, the call graph with imports.

FUNC = "'function alpha_' || p_partkey::varchar || '(x) {' || chr(10) || repeat('  if (x) {' || chr(10) || '    beta_' || (p_partkey + 1)::varchar || '(x);' || chr(10) || '  }' || chr(10), (p_size % 50)::int) || '}' || chr(10) || 'function beta_' || p_partkey::varchar || '(y) {' || chr(10) || '  return y;' || chr(10) || '}'"


def functions(spark: SparkSession, d: str) -> DataFrame:
    """(path, text): for every part two functions, the first with as many branches as the part's size says."""
    k = F.col("p_partkey").cast("string")
    loop = F.concat(F.lit("  if (x) {\n    beta_"), (F.col("p_partkey") + 1).cast("string"), F.lit("(x);\n  }\n"))
    text = F.concat(F.lit("function alpha_"), k, F.lit("(x) {\n"), F.repeat(loop, (F.col("p_size") % 50).cast("int")), F.lit("}\nfunction beta_"), k, F.lit("(y) {\n  return y;\n}"))
    return parts(spark, d).select(F.concat(F.lit("src/p"), k, F.lit(".js")).alias("path"), text.alias("text"))


TWO = "b as (select 'src/p' || p_partkey::varchar || '.js' as path, p_partkey::varchar as k, (p_size % 50)::int as n from part)"
COMPLEX = f"{TWO}, cx as (select path, 'alpha_' || k as name, 1 as line, 1 + n as complexity, 3 * n + 2 as loc from b union all select path, 'beta_' || k, 3 * n + 3, 1, 3 from b)"


@query("a21_complexity", f"with {COMPLEX} select * from cx")
def a21(spark: SparkSession, d: str) -> DataFrame:
    return S.complexity(functions(spark, d))


@query("r01_chunks_of_functions", f"""with b as (select 'src/p' || p_partkey::varchar || '.js' as path, (p_size % 50)::int as n, {FUNC} as text from part), c as (select path, n, string_split(text, chr(10)) as ls, unnest(range(0, case when 3 * n + 2 <= {S.LONG} then 1 else (3 * n + 2 + {S.PIECE} - 1) // {S.PIECE} end + 1)) as chunk from b),
x as (select *, case when 3 * n + 2 <= {S.LONG} then 1 else (3 * n + 2 + {S.PIECE} - 1) // {S.PIECE} end as pieces from c),
y as (select *, case when chunk = pieces then 3 * n + 3 when pieces = 1 then 1 else chunk * {S.PIECE} + 1 end as line_start, case when chunk = pieces then 3 * n + 5 when pieces = 1 then 3 * n + 2 else least((chunk + 1) * {S.PIECE}, 3 * n + 2) end as line_end from x)
select path, chunk::int as chunk, line_start::int as line_start, line_end::int as line_end, md5('// ' || path || chr(10) || case when chunk > 0 and chunk < pieces then ls[1] || '  (continued)' || chr(10) else '' end || array_to_string(ls[line_start:line_end], chr(10))) as digest from y""")
def r01f(spark: SparkSession, d: str) -> DataFrame:
    return S.chunks(functions(spark, d)).select("path", "chunk", "line_start", "line_end", F.md5("text").alias("digest"))


@query("j04_call_edges", f"with {TWO} select distinct path as file_path, path || '::alpha_' || k as source_qualified, 'beta_' || (k::bigint + 1)::varchar as target_qualified from b where n > 0")
def j04e(spark: SparkSession, d: str) -> DataFrame:
    _, e = S.call_graph(functions(spark, d))
    return e.filter("kind = 'CALLS'").select("file_path", "source_qualified", "target_qualified").distinct()


CODE_NODES = "n as (select 'm' || (p_partkey % 8)::varchar || '/f' || (p_partkey % 64)::varchar || '.py::' || nm as qualified_name, 'm' || (p_partkey % 8)::varchar || '/f' || (p_partkey % 64)::varchar || '.py' as file_path, 'f' || (p_partkey % 64)::varchar as stem, nm as name, p_size % 7 = 0 as is_test, p_partkey from (select *, 'fn_' || (p_partkey // 3)::varchar as nm from part))"
CODE_EDGES = """e as (select distinct a.qualified_name as source_qualified, a.file_path, b.name as target_qualified from lineitem join n a on a.p_partkey = l_partkey join n b on b.p_partkey = (l_suppkey * 7 + l_linenumber) % (select count(*) from part)),
i as (select distinct a.file_path, 'pkg.f' || (l_suppkey % 64)::varchar as imported from lineitem join n a on a.p_partkey = l_partkey where l_linenumber = 1)"""


def code_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges in which many files define a name, calls are bare, and files import others by name."""
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    file = F.concat(F.lit("m"), (k % 8).cast("string"), F.lit("/f"), (k % 64).cast("string"), F.lit(".py"))
    name = F.concat(F.lit("fn_"), F.floor(k / 3).cast("string"))
    n = p.select(F.concat_ws("::", file, name).alias("qualified_name"), file.alias("file_path"), name.alias("name"), F.lit(None).cast("string").alias("parent_name"), F.lit("Function").alias("kind"), (F.col("p_size") % 7 == 0).alias("is_test"), k)
    total = p.count()
    li = table(spark, d, "lineitem").select("l_partkey", "l_linenumber", "l_suppkey", ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % total).alias("to"))
    a = n.select(F.col("p_partkey").alias("l_partkey"), F.col("qualified_name").alias("source_qualified"), "file_path")
    b = n.select(F.col("p_partkey").alias("to"), F.col("name").alias("target_qualified"))
    # No broadcasts: a part's numbers are small in their file, its names are not.  A caller's rows come together, for what follows.
    calls = li.join(b.hint("merge"), "to").select("l_partkey", "target_qualified").join(a.hint("merge"), "l_partkey")
    calls = calls.select(F.lit("CALLS").alias("kind"), "source_qualified", "file_path", "target_qualified").repartition("source_qualified").distinct()
    imported = li.filter("l_linenumber = 1").select("l_partkey", F.concat(F.lit("pkg.f"), (F.col("l_suppkey") % 64).cast("string")).alias("target_qualified"))
    imports = imported.join(a.hint("merge"), "l_partkey").select(F.lit("IMPORTS_FROM").alias("kind"), F.col("file_path").alias("source_qualified"), "file_path", "target_qualified").distinct()
    return n, calls.unionByName(imports)


NAMED = f"df as (select name, count(distinct file_path) as files from n group by name), dm as (select name, {PFX.format('file_path')} as prefix, count(distinct file_path) as files_here from n group by 1, 2)"
SURE = f"(e.file_path = n.file_path or (n.name not in ({COMMON}) and (df.files = 1 or ({PFX.format('e.file_path')} = dm.prefix and dm.files_here = 1) or exists (select 1 from i where i.file_path = e.file_path and contains(i.imported, n.stem)))))"


@query("j04_import_evidence", f"with {CODE_NODES}, {CODE_EDGES}, {NAMED} select distinct n.qualified_name as target, e.source_qualified as caller from n join e on e.target_qualified = n.name join df on df.name = n.name join dm on dm.name = n.name and dm.prefix = {PFX.format('n.file_path')} where {SURE}")
def j04(spark: SparkSession, d: str) -> DataFrame:
    return G.callers(*code_graph(spark, d))


@query("j03_callers_low_confidence", f"with {CODE_NODES}, {CODE_EDGES} select distinct n.qualified_name as target, e.source_qualified as caller from n join e on e.target_qualified = n.name")
def j03l(spark: SparkSession, d: str) -> DataFrame:
    return G.callers(*code_graph(spark, d), low_confidence=True)


SEEDS = 4
CALLEES = f"cb as (select e.source_qualified as caller, n.qualified_name as target, e.file_path = n.file_path as same, df.files, dm.files_here, {PFX.format('e.file_path')} = dm.prefix as mod, max((e.file_path = n.file_path)::int) over (partition by e.source_qualified, n.name) as has_local from e join n on e.target_qualified = n.name join df on df.name = n.name join dm on dm.name = n.name and dm.prefix = {PFX.format('n.file_path')}), ce as (select distinct caller, target from cb where same or (has_local = 0 and (files = 1 or (mod and files_here = 1))))"


@query("r10_expand_calls", f"""with {CODE_NODES}, {CODE_EDGES}, {NAMED}, {CALLEES}, cr as (select distinct n.qualified_name as target, e.source_qualified as caller from n join e on e.target_qualified = n.name join df on df.name = n.name join dm on dm.name = n.name and dm.prefix = {PFX.format('n.file_path')} where {SURE}),
s as (select distinct qualified_name as node from n where p_partkey <= {SEEDS}), x as (select caller as node, 'caller' as via from cr where target in (select node from s) union select target, 'callee' from ce where caller in (select node from s) union select caller, 'test' from cr where target in (select node from s) and caller in (select qualified_name from n where is_test))
select node, 1 as hops, list_sort(list(distinct via)) as via from x where node not in (select node from s) group by node""")
def r10c(spark: SparkSession, d: str) -> DataFrame:
    n, e = code_graph(spark, d)
    seeds = n.filter(F.col("p_partkey") <= SEEDS).select(F.col("qualified_name").alias("node")).distinct()
    return G.expand_calls(n, e, seeds, 1)


@query("r08_symbols", "with " + f"{FILES.replace('f as', 'f0 as', 1)}, f as (select path, text from f0 union all select path, text from (select 'src/p' || p_partkey::varchar || '.js' as path, {FUNC.replace('function alpha_', 'class Alpha_').replace('function beta_', 'fn beta_')} as text from part))" + f", s as (select path, list_filter(flatten([{', '.join(f'regexp_extract_all(text, {_quoted(x)}, 1)' for x in R.SYMBOL_PATTERNS)}]), lambda x: length(x) >= 2) as s from f) select path, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i)[1:5], ',') as symbols from s where len(s) > 0")
def r08(spark: SparkSession, d: str) -> DataFrame:
    two = functions(spark, d).withColumn("text", F.regexp_replace(F.regexp_replace("text", "function alpha_", "class Alpha_"), "function beta_", "fn beta_"))
    # Through a generator no filter is pushed, which would look for symbols before the parts are dealt, and twice.
    s = files(spark, d).unionByName(two).select("path", F.explode(F.array(R.symbols(F.col("text")))).alias("s")).filter(F.size("s") > 0)
    return s.select("path", F.concat_ws(",", "s").alias("symbols"))


@query("explicit_debt", f"""with {FILES}, l as (select path as file, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line from f), k as (select *, case {" ".join(f"when regexp_matches(content, '(^|[^A-Za-z0-9_]){m}') then '{m}'" for m in A.DEBT_MARKERS)} end as kind from l) select file, line::int as line, kind from k where kind is not null""")
def explicit_debt(spark: SparkSession, d: str) -> DataFrame:
    return A.explicit_debt(A.lines(files(spark, d), "path", "text")).select("file", "line", "kind")


# --- Scores over real inputs.


@query(
    "a25_hot_spots",
    f"""{LINES}, fd as (select file, count(*) as n from ({" union all ".join("select file from l where " + (" or ".join(rule_sql(r) for r in K.RULES if r.family == fam)) for fam in ("sqli", "cmdi", "deser", "xss"))}) group by file), {COMPLEX.replace("b as", "bb as", 1).replace("from b ", "from bb ").replace("from b)", "from bb)")},
x as (select file, '' as symbol, 'findings' as reason, 'medium' as severity from fd where n > 1 union all select path, name, 'complexity', case when complexity > 40 then 'high' else 'medium' end from cx where complexity >= 30 union all select 'src/s' || s_suppkey::varchar, '', 'antipattern', 'high' from supplier where s_acctbal < 0) select * from x""",
)
def a25(spark: SparkSession, d: str) -> DataFrame:
    per = K.line_findings(files(spark, d), ("sqli", "cmdi", "deser", "xss")).groupBy("file").agg((F.count("*") + 2).alias("n"))
    cx = S.complexity(functions(spark, d)).select(F.col("path").alias("file"), "name", "complexity")
    bad = table(spark, d, "supplier").select(F.concat(F.lit("src/s"), F.col("s_suppkey").cast("string")).alias("path"), F.lit("god_class").alias("kind"), F.when(F.col("s_acctbal") < 0, "high").otherwise("medium").alias("severity"))
    return M.hot_spots(per, cx, bad)


@query("j22_fk_inference", """with m as (select distinct lower(replace(n_name, ' ', '_')) as model from nation union select distinct lower(r_name) || 's' from region), b as (select distinct model from m),
f as (select distinct p_type as model, lower(replace(n_name, ' ', '_')) || '_id' as field from part join nation on n_nationkey = p_partkey % 25 union select distinct p_type, lower(r_name) || 'Id' from part join region on r_regionkey = p_partkey % 5),
o as (select f.model, field, unnest([lower(regexp_replace(field, '(_id|Id)$', '')), lower(regexp_replace(field, '(_id|Id)$', '')) || 's', regexp_replace(lower(regexp_replace(field, '(_id|Id)$', '')), 's$', '')]) as name, unnest([0, 1, 2]) as r from f)
select o.model, field, arg_min(b.model, r) as target from o join b on b.model = o.name where o.model <> b.model group by o.model, field""")
def j22(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(F.col("n_nationkey"), F.lower(F.translate("n_name", " ", "_")).alias("n"))
    region = table(spark, d, "region").select("r_regionkey", F.lower("r_name").alias("r"))
    part = table(spark, d, "part").select("p_type", "p_partkey")
    models = nation.select(F.col("n").alias("model")).union(region.select(F.concat("r", F.lit("s")))).distinct()
    a = part.join(nation, F.col("p_partkey") % 25 == F.col("n_nationkey")).select(F.col("p_type").alias("model"), F.concat("n", F.lit("_id")).alias("field"))
    b = part.join(region, F.col("p_partkey") % 5 == F.col("r_regionkey")).select(F.col("p_type").alias("model"), F.concat("r", F.lit("Id")).alias("field"))
    return C.infer_keys(a.union(b).distinct(), models)


QUARTERS = "q as (select o_orderpriority as service, date_trunc('month', o_orderdate)::timestamp as ts, count(*) as anti_n, round(sum(o_totalprice) / count(*) / 10000)::bigint as cc, (count(*) filter (o_orderstatus = 'F'))::bigint as god, (count(*) filter (o_orderstatus = 'P'))::bigint as cyc, (count(distinct o_custkey))::bigint as cov from orders group by 1, 2)"


@query("a16_trend", f"with {QUARTERS}, x as (select service, ts, anti_n - lag(anti_n) over w as a, cc - lag(cc) over w as c, god - lag(god) over w as g, cyc - lag(cyc) over w as y, cov - lag(cov) over w as v from q window w as (partition by service order by ts)) select service, ts, case when 2 * a + c + 3 * g + 3 * y - 0.5 * v > 1 then 'degrading' when 2 * a + c + 3 * g + 3 * y - 0.5 * v < -1 then 'improving' else 'stable' end as trend from x where a is not null")
def a16(spark: SparkSession, d: str) -> DataFrame:
    names = ["anti_n", "cc", "god", "cyc", "cov"]
    count_if = lambda s: F.sum((F.col("o_orderstatus") == s).cast("long"))
    q = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("service"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ts"))
    q = q.agg(F.count("*").alias("anti_n"), F.round(F.sum("o_totalprice") / F.count("*") / 10000).cast("long").alias("cc"), count_if("F").alias("god"), count_if("P").alias("cyc"), F.countDistinct("o_custkey").alias("cov"))
    c = M.compare_snapshots(q, "service", "ts", names).filter("d_anti_n is not null")
    return c.select("service", "ts", M.trend(*(F.col(f"d_{x}") for x in names)).alias("trend"))


# --- Layers.

DIRS = ("src/", "api/", "services/", "db/migrations/", "models/dto/", "utils/", "config/", "tests/", "x/")
SIGS = tuple(p for p, _, _ in L.SIGNALS)


def _sig(n: str) -> str:
    return f"{_list(SIGS)}[1 + ({n}) % {len(SIGS)}]"


MODULE_FILES = f"mf as (select {_list(DIRS)}[1 + p_size % {len(DIRS)}] || 'm' || p_partkey::varchar || ['.rs', '_config.py', '/main.rs', '.ts'][1 + p_partkey % 4] as path, case when p_partkey % 3 = 0 then 'nothing' else {_sig('p_partkey')} || chr(10) || {_sig('p_partkey * 7 + p_size')} || chr(10) || {_sig('p_size * 11')} end as text from part)"
SIGNAL_ROWS = "sg(pattern, layer, weight) as (values " + ", ".join(f"({_quoted(p)}, '{a}', {w})" for p, a, w in L.SIGNALS) + ")"
FOLDER_ROWS = "fd(name, layer) as (values " + ", ".join(f"('{n}', '{k}')" for k, ns in L.FOLDERS.items() for n in ns) + ")"
SCORES = f"""with {MODULE_FILES}, {SIGNAL_ROWS}, {FOLDER_ROWS}, pt as (select path, unnest(string_split(lower(path), '/')) as name from mf),
sc as (select path, layer, sum(w)::int as score from (select path, layer, weight as w from mf join sg on contains(text, pattern) union all select path, layer, 2 from pt join fd using (name)) group by 1, 2)"""
RANK = "case layer " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(L.LAYERS)) + " end"


def module_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, text): for every part a module in some folder, with some of the signals."""
    k, s = F.col("p_partkey"), F.col("p_size")
    path = F.concat(_pick(DIRS, s), F.lit("m"), k.cast("string"), _pick((".rs", "_config.py", "/main.rs", ".ts"), k))
    text = F.when(k % 3 == 0, "nothing").otherwise(F.concat_ws("\n", _pick(SIGS, k), _pick(SIGS, k * 7 + s), _pick(SIGS, s * 11)))
    return parts(spark, d).select(path.alias("path"), text.alias("text"))


@query("a11_layer_signals", SCORES + " select path, layer, score from sc where score <> 0")
def a11s(spark: SparkSession, d: str) -> DataFrame:
    return L.layer_scores(module_files(spark, d))


CLASSES = (
    SCORES
    + f""", best as (select path, layer from (select path, layer, score, row_number() over (partition by path order by score desc, {RANK}) as rn from sc) where rn = 1 and score > 0),
cl as (select mf.path, case when contains(lower(mf.path), 'test') or contains(lower(mf.path), 'spec') then 'test' when contains(lower(mf.path), '.env') or regexp_matches(lower(mf.path), '({"|".join(x.replace(".", "[.]") for x in L.CONFIG_ENDS)})$') then 'config'
 when regexp_matches(lower(mf.path), '({"|".join(x.replace(".", "[.]") for x in L.ENTRY_ENDS)})$') then 'utility' else coalesce(best.layer, 'unknown') end as layer from mf left join best on best.path = mf.path)"""
)


@query("a11_layers", CLASSES + " select path, layer from cl")
def a11l(spark: SparkSession, d: str) -> DataFrame:
    return L.classify(module_files(spark, d))


UNKNOWN = """with m as (select s_suppkey as path, case when s_nationkey % 3 = 0 then 'service' else 'unknown' end as layer from supplier),
i as (select distinct l_suppkey as src, (l_partkey % (select count(*) from supplier)) as dst from lineitem),
c as (select path, layer, (select count(*) from i where dst = path and src in (select path from m)) as fi, (select count(*) from i where src = path and dst in (select path from m)) as fo from m),
t as (select greatest(2 * coalesce((select fi from c where fi > 0 order by fi limit 1 offset (select count(*) // 2 from c where fi > 0)), 1), 3) as th)"""


@query("a10_refined_layers", UNKNOWN + " select path, case when layer <> 'unknown' then layer when fi >= th and fo <= 1 then 'model' when fi >= th then 'utility' when fo >= th and fi <= 1 then 'controller' when fo > fi and fo >= 2 then 'service' else 'unknown' end as layer from c, t")
def a10r(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    n = s.count()
    m = s.select(F.col("s_suppkey").alias("path"), F.when(F.col("s_nationkey") % 3 == 0, "service").otherwise("unknown").alias("layer"))
    i = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % n).alias("dst")).distinct()
    return L.refine(m, i)
