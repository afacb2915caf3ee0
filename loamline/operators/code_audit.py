"""Findings in source text by language: families of line rules as data, and rules that need the lines around.

A family gives a line one finding at most.  Lines that are comments have none.  Line
rules stay in the JVM, one pass over all lines of all files: a literal that each of a
rule's patterns needs is looked for first, the pattern only where it stands.  Rules
about blocks (tests, empty handlers) read a file at a time, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.sources.files import is_test_path, rows_of

PY, JS, GO, RS, DART = ("py",), ("js", "ts", "jsx", "tsx"), ("go",), ("rs",), ("dart",)


@dataclass(frozen=True)
class CodeRule:
    """A line of a file with one of the extensions that one of the patterns fits, that has one of the words `needs`, none of `unless`, in a file whose path or text fits."""

    family: str
    exts: tuple[str, ...]
    patterns: tuple[str, ...]
    literals: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    not_pattern: str | None = None
    in_file: str | None = None
    lower: bool = False
    in_security_file: bool = False


# Families with their category and severity, the rules' patterns, the words that make a file one about security,
# and paths that serve diagnostics.
FAMILIES = {
    "sqli": ("SqlInjection", "high"),
    "cmdi": ("CommandInjection", "critical"),
    "pathtr": ("PathTraversal", "high"),
    "deser": ("InsecureDeserialization", "high"),
    "crypto": ("WeakCryptography", "medium"),
    "xss": ("XssVulnerability", "high"),
    "ssrf": ("Ssrf", "high"),
    "debug-ep": ("ExposedDebugEndpoint", "medium"),
}
PY_ROUTE = r"@(app|router)\.(get|post|put|delete|patch|route)\s*\("
JS_ROUTE = r"(app|router)\.(get|post|put|delete|patch|use)\s*\("
PY_ROUTE_PATH = r"""@(app|router)\.(get|post|route|api_route)\s*\(\s*['"]([^'"]+)['"]\s*"""
JS_ROUTE_PATH = r"""(app|router)\.(get|post|use|all)\s*\(\s*['"]([^'"]+)['"]\s*"""
DEBUG_PATHS = ("/debug", "/_debug", "/__debug", "/admin/debug", "/phpinfo", "/actuator", "/actuator/health", "/actuator/env", "/heapdump", "/.env", "/metrics")
SECURITY_WORDS = ("password", "auth", "token", "secret", "key", "otp", "crypt", "hash", "sign", "verify")
URL_LITERALS = ('"http', "'http", "`http")
RULES = (
    CodeRule(
        "sqli",
        PY,
        (
            r"""(?i)f["'][^"']*\b(SELECT|INSERT|UPDATE|DELETE|WHERE)\b[^"']*\{""",
            r"""(?i)\.execute\s*\([^)]*(\+|\.format\s*\(|%\s*[(\w])""",
            r"(?i)\.raw\s*\(\s*[a-zA-Z_]",
        ),
    ),
    CodeRule("sqli", JS, (r"(?i)`[^`]*\b(SELECT|INSERT|UPDATE|DELETE|WHERE)\b[^`]*\$\{", r"(?i)\.(query|execute)\s*\([^)]*\+")),
    CodeRule(
        "cmdi",
        PY,
        (
            r"(?i)subprocess\.(run|Popen|call|check_output)\s*\([^)]*shell\s*=\s*True",
            r"os\.system\s*\(\s*[a-zA-Z_]",
            r"os\.popen\s*\(\s*[a-zA-Z_]",
            r"\b(exec|eval)\s*\(\s*[a-zA-Z_]",
        ),
    ),
    CodeRule("cmdi", JS, (r"\b(exec|execSync|spawn|spawnSync)\s*\(\s*(`[^`]*\$\{|[a-zA-Z_])", r"\beval\s*\(\s*[a-zA-Z_]"), ("exec", "spawn", "eval")),
    CodeRule("cmdi", GO, (r"exec\.Command\s*\(\s*(fmt\.Sprintf|[a-zA-Z_]+\s*\+)",), ("exec.Command",)),
    CodeRule("cmdi", RS, (r"Command::new\s*\(\s*(&?format!|&?\w+\s*\+)",), ("Command::new",)),
    CodeRule(
        "pathtr",
        PY,
        (r"\bopen\s*\(\s*[a-zA-Z_]", r"(?i)(send_file|send_from_directory|FileResponse)\s*\(\s*[a-zA-Z_]"),
        needs=("request", "param", "arg"),
        unless=("os.path.abspath", "pathlib", ".resolve()", "secure_filename"),
    ),
    CodeRule(
        "pathtr",
        JS,
        (r"fs\.(readFile|readFileSync|createReadStream)\s*\(\s*[a-zA-Z_]", r"res\.sendFile\s*\(\s*[a-zA-Z_]"),
        ("fs.", "res."),
        needs=("req.", "params", "query"),
        unless=("path.resolve", "path.normalize", "path.join"),
    ),
    CodeRule("deser", PY, (r"pickle\.(loads?|Unpickler)\s*\(", r"marshal\.loads?\s*\(", r"jsonpickle\.decode\s*\("), ("pickle.", "marshal.")),
    CodeRule("deser", PY, (r"yaml\.load\s*\([^)]*\)",), ("yaml.load",), unless=("safe_load",), not_pattern=r"yaml\.load\s*\([^)]*Loader\s*=\s*yaml\.SafeLoader"),
    CodeRule("deser", JS, (r"\bunserialize\s*\(\s*[a-zA-Z_]",), ("unserialize",)),
    CodeRule("crypto", PY, (r"hashlib\.(md5|sha1)\s*\(",), ("hashlib.",), needs=("password", "hash", "sign", "verify", "token"), lower=True),
    CodeRule("crypto", PY, (r"\brandom\.(random|randint|choice|randrange)\s*\(",), ("random.",), in_security_file=True),
    CodeRule("crypto", PY, (r"(?i)(DES|RC4|Blowfish|RC2)",), needs=("(",), not_pattern=r"hashlib\.(md5|sha1)\s*\("),
    CodeRule("crypto", PY, (r"""(?i)(iv|nonce)\s*=\s*b['"]\\x00""",), ("\\x00",), not_pattern=r"hashlib\.(md5|sha1)\s*\("),
    CodeRule("crypto", JS, (r"""createHash\s*\(\s*['"](?:md5|sha1)['"]\s*\)""",), ("createHash",), needs=("password", "hash", "sign", "verify"), lower=True),
    CodeRule("crypto", JS, (r"Math\.random\s*\(",), ("Math.random",), in_security_file=True, not_pattern=r"""createHash\s*\(\s*['"](?:md5|sha1)['"]\s*\)"""),
    CodeRule("crypto", GO, (r"(md5|sha1)\.New\s*\(",), (".New",), needs=("password", "hash"), lower=True),
    CodeRule("crypto", GO, (r"(md5|sha1)\.New\s*\(",), (".New",), in_security_file=True),
    CodeRule("crypto", RS, (r"use\s+(md5|sha1)",), ("use",), in_security_file=True),
    CodeRule(
        "xss",
        JS,
        (
            r"\.outerHTML\s*=",
            r"document\.write\s*\(\s*[a-zA-Z_]",
            r"""insertAdjacentHTML\s*\(\s*['"][^'"]+['"]\s*,\s*[a-zA-Z_]""",
            r"\beval\s*\(\s*[a-zA-Z_]",
            r"new\s+Function\s*\(\s*[a-zA-Z_]",
        ),
        (".outerHTML", "document.write", "insertAdjacentHTML", "eval", "Function"),
    ),
    CodeRule("xss", JS, (r"\.innerHTML\s*[+=]",), (".innerHTML",), unless=('innerHTML = "', "innerHTML = '", "innerHTML = `")),
    CodeRule("xss", JS, (r"dangerouslySetInnerHTML\s*=\s*\{\s*\{?\s*__html\s*:",), ("dangerouslySetInnerHTML",)),
    CodeRule("ssrf", PY, (r"(?i)(requests|httpx)\.(get|post|put|delete|patch|head)\s*\(\s*[a-zA-Z_]", r"urllib\.request\.urlopen\s*\(\s*[a-zA-Z_]"), unless=URL_LITERALS, in_file=PY_ROUTE),
    CodeRule(
        "ssrf",
        ("js", "ts"),
        (r"\bfetch\s*\(\s*[a-zA-Z_]", r"axios\.(get|post|put|delete|patch)\s*\(\s*[a-zA-Z_]", r"https?\.get\s*\(\s*[a-zA-Z_]"),
        ("fetch", "axios.", "http"),
        unless=URL_LITERALS,
        in_file=JS_ROUTE,
    ),
)
#: Files that render markup of their own making, and what a safe sink is worth.
CONTROLLED = ("mermaid", "chart.js", "Chart.js", "d3.select")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def lowered(severity: Column) -> Column:
    """A severity in a test file: one step less."""
    return F.when(severity == "critical", "high").when(severity == "high", "medium").when(severity == "medium", "low").otherwise(severity)


def fits(r: CodeRule) -> Column:
    """Whether a line (ext, content, low, is_security, in_route) meets a rule."""
    c = F.col("content")
    ok = F.col("ext").isin(*r.exts)
    if r.literals:
        ok = ok & any_of(c, r.literals)
    if r.in_file:
        ok = ok & F.col("in_route")
    if r.in_security_file:
        ok = ok & F.col("is_security")
    if r.needs:
        words = any_of(F.col("low") if r.lower else c, r.needs)
        ok = ok & ((words | F.col("is_security")) if r.lower else words)
    if r.unless:
        ok = ok & ~any_of(c, r.unless)
    hit = F.lit(False)
    for p in r.patterns:
        hit = hit | c.rlike(p)
    ok = ok & hit
    return ok & ~c.rlike(r.not_pattern) if r.not_pattern else ok


def lines_of(files: DataFrame) -> DataFrame:
    """Lines of files (path, text) that are no comments, with what the rules ask about their file."""
    text = F.coalesce("text", F.lit(""))
    ext = extension(F.col("path"))
    security = any_of(F.lower("path"), SECURITY_WORDS)
    route = ((ext == "py") & text.rlike(PY_ROUTE)) | (ext.isin("js", "ts") & text.rlike(JS_ROUTE))
    about = files.select(F.col("path").alias("file"), ext.alias("ext"), security.alias("is_security"), is_test_path(F.col("path")).alias("is_test"), route.alias("in_route"), any_of(text, CONTROLLED).alias("controlled"), F.posexplode(F.split(text, "\n")).alias("at", "content"))
    trimmed = F.trim("content")
    comment = trimmed.startswith("//") | trimmed.startswith("#") | trimmed.startswith("/*") | trimmed.startswith("*")
    return about.filter(~comment).withColumn("line", F.col("at") + 1).withColumn("low", F.lower("content")).drop("at")


def line_findings(files: DataFrame, families: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
    """(file, line, rule, category, severity) of the families' line rules."""
    hits = []
    for family in families:
        category, base = FAMILIES[family]
        hit = F.lit(False)
        for r in RULES:
            if r.family == family:
                hit = hit | fits(r)
        severity = F.lit(base)
        if family == "debug-ep":
            route = F.lower(F.when(F.col("ext") == "py", F.regexp_extract("content", PY_ROUTE_PATH, 3)).when(F.col("ext").isin("js", "ts"), F.regexp_extract("content", JS_ROUTE_PATH, 3)).otherwise(""))
            for p in DEBUG_PATHS:
                hit = hit | (route == p) | route.startswith(p + "/")
        if family == "crypto":
            severity = F.when(F.col("is_security"), "high").otherwise(base)
        if family == "xss":
            markup = F.col("content").rlike(r"\.innerHTML\s*[+=]") | F.col("content").rlike(r"\.outerHTML\s*=")
            other = F.lit(False)
            for p in (p for r in RULES if r.family == "xss" and "dangerously" not in r.patterns[0] for p in r.patterns):
                other = other | F.col("content").rlike(p)
            severity = F.when((F.col("controlled") & markup) | ~other, "low").otherwise(base)
        severity = F.when(F.col("is_test"), lowered(severity)).otherwise(severity)
        hits.append(F.when(hit, F.struct(F.lit(family).alias("rule"), F.lit(category).alias("category"), severity.alias("severity"))))
    found = lines_of(files).select("file", "line", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return found.select("file", "line", "h.*")


# Calls that return no error, and conversions.
NO_ERROR = ("fmt.Print", "fmt.Println", "fmt.Printf", "fmt.Fprint", "fmt.Fprintln", "fmt.Fprintf", "fmt.Sprint", "fmt.Sprintln", "fmt.Sprintf", "len(", "cap(", "append(", "make(", "new(", "copy(", "delete(", "close(")
CONVERSIONS = ("[]", "string(", "int(", "int8(", "int16(", "int32(", "int64(", "uint(", "float32(", "float64(", "byte(", "rune(", "bool(")


def _rust(path: str, lines: list[str]) -> Iterator[tuple[int, str, str]]:
    """Panics outside of test blocks: a block opens at the marker and ends where the braces are back at its depth."""
    if re.search(r"(main|build)\.rs$", path.lower()):
        return
    depth, block = 0, None
    for at, line in enumerate(map(str.strip, lines), 1):
        if line.startswith(("//", "/*", "*")):
            continue
        if "#[cfg(test)]" in line:
            block = depth
        depth += line.count("{") - line.count("}")
        if block is not None and "}" in line and depth <= block:
            block = None
        if block is not None or "#[test]" in line:
            continue
        if ".unwrap()" in line:
            yield at, "err-rust", "medium"
        elif ".expect(" in line:
            yield at, "err-rust", "low" if '.expect("' in line and '.expect("")' not in line else "medium"


def _python(path: str, lines: list[str]) -> Iterator[tuple[int, str, str]]:
    after = [*map(str.strip, lines[1:]), None]
    for at, (line, nxt) in enumerate(zip(map(str.strip, lines), after, strict=True), 1):
        if line == "except:" or line.startswith("except: "):
            yield at, "err-py-bare", "high"
        elif line.startswith(("except Exception:", "except Exception as ")) and nxt == "pass":
            yield at, "err-py-pass", "medium"
        elif line.startswith("except BaseException"):
            yield at, "err-py-base", "high"


def _javascript(path: str, lines: list[str]) -> Iterator[tuple[int, str, str]]:
    after = [*map(str.strip, lines[1:]), None]
    for at, (line, nxt) in enumerate(zip(map(str.strip, lines), after, strict=True), 1):
        tail = line.rsplit("catch", 1)[-1] if "catch" in line else ""
        empty = re.search(r"^[^{]*\{\s*\}", tail) is not None
        opens = line.startswith("catch") or (line.startswith("} catch") and line.endswith("{"))
        if empty or (opens and nxt is not None and (nxt == "}" or nxt.startswith("} finally"))):
            yield at, "err-js-empty", "medium"


def _go(path: str, lines: list[str]) -> Iterator[tuple[int, str, str]]:
    for at, line in enumerate(map(str.strip, lines), 1):
        discards = line.startswith(("_ =", "_ :=")) or ", _ :=" in line or ", _ =" in line
        if line.startswith("//") or not discards or "(" not in line or ")" not in line:
            continue
        value = line.split("=", 1)[1].lstrip()
        if not value.startswith(CONVERSIONS) and not any(f in value for f in NO_ERROR):
            yield at, "err-go-discard", "medium"


def _dart(path: str, lines: list[str]) -> Iterator[tuple[int, str, str]]:
    for at, line in enumerate(map(str.strip, lines), 1):
        if not line.startswith("//") and "catch" in line and "(" in line:
            before = line.split("catch", 1)[0]
            if " on " not in before and not before.strip().startswith("on "):
                yield at, "err-dart-bare", "medium"


BLOCK_RULES = {"rs": _rust, "py": _python, "go": _go, "dart": _dart} | dict.fromkeys(JS, _javascript)


def error_rows(path: str, text: str) -> Iterator[tuple]:
    """(file, line, rule, category, severity) of errors that a file's code hides."""
    rule = BLOCK_RULES.get(path.rsplit(".", 1)[-1]) if "." in path else None
    for line, name, severity in rule(path, text.split("\n")) if rule else ():
        yield path, line, name, "UnsafeErrorHandling", severity


def error_findings(files: DataFrame) -> DataFrame:
    """Findings about error handling.  Rust's tests may panic; elsewhere a test's finding is one step less grave."""
    found = rows_of(files, error_rows, "file string, line int, rule string, category string, severity string")
    test = is_test_path(F.col("file"))
    found = found.filter(~(test & (F.col("rule") == "err-rust")))
    return found.withColumn("severity", F.when(test, lowered(F.col("severity"))).otherwise(F.col("severity")))


def config_findings(files: DataFrame) -> DataFrame:
    """(file, line, rule, category, severity) of settings: debug switches, open origins, binding to all, containers, install scripts, settings files without a guard.

    A finding about a file as a whole has line 0.  Folders are those of the files given; settings files that begin with a dot have
    to be among them (`files.hidden`).
    """
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    t = files.select(F.col("path").alias("file"), name.alias("name"), folder.alias("folder"), extension(F.col("path")).alias("ext"), F.coalesce("text", F.lit("")).alias("text"))
    ln = t.select("file", "name", "folder", "ext", F.posexplode(F.split("text", "\n")).alias("at", "content")).withColumn("s", F.trim("content")).withColumn("u", F.upper(F.trim("content")))
    c, s, u, n = F.col("content"), F.col("s"), F.col("u"), F.col("name")
    origins = (s.contains("CORS_ALLOW_ALL_ORIGINS") & s.contains("True")) | (s.contains("allow_origins") & s.contains('"*"')) | (s.contains("origins") & s.contains('"*"') & s.contains("cors"))
    js_origins = (c.contains("cors()") & ~c.contains("//")) | (c.contains("cors(") & c.contains("'*'")) | (c.contains("Access-Control-Allow-Origin") & c.contains("*"))
    docker = n == "Dockerfile"
    rules = [
        ("debug-django", "DebugEnabled", "high", ((n == "settings.py") | F.col("file").rlike(r"(^|/)settings/(base|production)\.py$")) & s.startswith("DEBUG") & s.contains("True")),
        ("debug-flask", "DebugEnabled", "medium", n.isin("app.py", "main.py", "run.py", "server.py", "wsgi.py") & (c.contains("debug=True") | c.contains("debug = True"))),
        ("cors-open", "InsecureConfig", "medium", n.isin("settings.py", "main.py", "app.py", "config.py") & origins),
        ("cors-js", "InsecureConfig", "medium", n.isin("server.js", "server.ts", "app.js", "app.ts", "index.js", "index.ts") & js_origins),
        ("bind-all", "InsecureConfig", "low", F.col("ext").isin("py", "js", "ts", "go", "rs") & c.contains("0.0.0.0") & ~s.startswith("//") & ~s.startswith("#")),
        ("docker-root", "InsecureConfig", "medium", docker & u.startswith("USER ROOT")),
        ("docker-latest", "InsecureConfig", "low", docker & u.startswith("FROM ") & u.contains(":LATEST")),
        ("docker-copy-all", "InsecureConfig", "medium", docker & (u.startswith("COPY . .") | u.startswith("ADD . ."))),
    ]
    hits = [F.when(cond, F.struct(F.lit(r).alias("rule"), F.lit(k).alias("category"), F.lit(v).alias("severity"))) for r, k, v, cond in rules]
    lines = ln.select("file", "folder", (F.col("at") + 1).alias("line"), F.explode(F.array_compact(F.array(*hits))).alias("h")).select("file", "folder", "line", "h.*")
    has = lambda x: t.filter(F.col("name") == x).select("folder").distinct()
    guarded = lines.filter("rule = 'docker-copy-all'").join(has(".dockerignore"), "folder", "left_semi").select("file", "line", "rule")
    lines = lines.join(guarded, ["file", "line", "rule"], "left_anti").select("file", "line", "rule", "category", "severity")

    def whole(rows: DataFrame, rule: str, category: str, severity: str) -> DataFrame:
        return rows.select("file", F.lit(0).alias("line"), F.lit(rule).alias("rule"), F.lit(category).alias("category"), F.lit(severity).alias("severity"))

    scripts = t.filter("name = 'package.json'")
    start = F.get_json_object("text", "$.scripts.start")
    server = start.contains("node ") & ~start.contains("NODE_ENV=production") & ~start.contains("cross-env NODE_ENV") & start.rlike("server|app|index")
    fetches = [whole(scripts.filter(F.get_json_object("text", f"$.scripts.{k}").rlike("curl|wget|http")), f"npm-{k}", "InsecureConfig", "high") for k in ("preinstall", "postinstall")]
    env = t.filter("name = '.env'")
    ignores = t.filter(F.col("name") == ".gitignore")
    listed = ignores.filter(F.exists(F.split("text", "\n"), lambda x: F.trim(x).isin(".env", ".env*", "*.env", ".env.*"))).select("folder").distinct()
    unlisted = ignores.join(env.select("folder"), "folder", "left_semi").join(listed, "folder", "left_anti")
    parts = [
        lines,
        whole(scripts.filter(server), "node-env", "DebugEnabled", "low"),
        *fetches,
        whole(t.filter("name = 'Dockerfile'").filter(~F.exists(F.split("text", "\n"), lambda x: F.upper(F.trim(x)).startswith("USER "))), "docker-no-user", "InsecureConfig", "medium"),
        whole(env.join(has(".env.example").union(has(".env.sample")).distinct(), "folder", "left_anti"), "env-no-example", "InsecureConfig", "low"),
        whole(unlisted, "env-not-gitignored", "InsecureConfig", "high"),
        whole(env.join(has(".gitignore"), "folder", "left_anti"), "no-gitignore", "InsecureConfig", "high"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Strings whose removal is looked for, and words of commits that move code about.
HISTORY_WORDS = ("password", "secret", "AKIA", "api_key", "token")
CODE_MOVES = ("vuln_pattern", "vuln-pattern", "audit", "security", "secret", "refactor", "split", "extract", "move", "test", "spec", "lint", "clippy", "fmt", "doc", "readme", "changelog")


def history_findings(removals: DataFrame, most: int = 10) -> DataFrame:
    """One row (commits, n, severity) if commits deleted files with a sensitive string; removals: (commit, subject, text) of deleted files.

    Commits that speak of detection, patterns or scanners, or with two words of code moves, are none.  `commits` lists `most` of them, in order.
    """
    low = F.lower("subject")
    moves = F.lit(0)
    for w in CODE_MOVES:
        moves = moves + low.contains(w).cast("int")
    real = removals.filter(any_of(F.col("text"), HISTORY_WORDS) & (moves < 2) & ~any_of(low, ("detection", "pattern", "scanner"))).select("commit", "subject").distinct()
    first = F.slice(F.array_sort(F.collect_list(F.concat_ws(" ", "commit", "subject"))), 1, most)
    top = real.orderBy("commit", "subject").limit(most)
    return top.agg(first.alias("commits")).join(F.broadcast(real.agg(F.count("*").alias("n")))).filter("n > 0").withColumn("severity", F.lit("high"))
