"""Boards, snapshots, routes, models and infrastructure files as rows; boards and snapshots as text again."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.sources.files import rows_of

TASK = re.compile(r"^\s*-\s+\*\*([^*]+)\*\*\s*([^`]*)((?:`[^`]*`\s*)*)$")


def board_rows(path: str, text: str) -> Iterator[tuple]:
    """(board, column, position, task, title, priority, sync, due, tags, links): headings are columns, `- **ID** title` tasks, bullets below links."""
    column, tasks = None, []
    for ln in text.split("\n"):
        if ln.startswith("## "):
            column = ln[3:].strip()
        elif column and (m := TASK.match(ln)):
            tokens = re.findall(r"`([^`]*)`", m[3])
            pick = lambda p, t=tokens: next((x[len(p) :] for x in t if x.startswith(p)), None)
            due = next((x for x in tokens if re.fullmatch(r"\d{4}-\d\d-\d\d", x)), None)
            tasks.append([path, column, len(tasks), m[1].strip(), m[2].strip(), pick("prio:"), pick("sync:"), due, [x[1:] for x in tokens if x.startswith("#")], []])
        elif tasks and (m := re.match(r"^\s{2,}-\s+(.*\S)", ln)):
            tasks[-1][9].append(m[1].strip("`"))
    yield from (tuple(t) for t in tasks)


BOARD = "board string, column string, position int, task string, title string, priority string, sync string, due string, tags array<string>, links array<string>"


def boards(files: DataFrame) -> DataFrame:
    return rows_of(files, board_rows, BOARD)


def board_text(tasks: DataFrame) -> DataFrame:
    """(board, value): the boards' Markdown again."""
    mark = lambda p, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f" `{p}"), c, F.lit("`"))).otherwise("")
    tags = F.array_join(F.transform("tags", lambda t: F.concat(F.lit(" `#"), t, F.lit("`"))), "")
    links = F.array_join(F.transform("links", lambda t: F.concat(F.lit("\n  - "), t)), "")
    line = F.concat(F.lit("- **"), "task", F.lit("** "), "title", mark("prio:", "priority"), mark("sync:", "sync"), tags, mark("", "due"), links)
    t = tasks.withColumn("line", line)
    cols = t.groupBy("board", "column").agg(F.min("position").alias("at"), F.array_sort(F.collect_list(F.struct("position", "line"))).alias("ls"))
    block = cols.select("board", F.struct("at", F.concat(F.lit("## "), "column", F.lit("\n"), F.array_join(F.col("ls.line"), "\n"), F.lit("\n")).alias("text")).alias("b"))
    return block.groupBy("board").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["text"]), "\n").alias("value"))


def board_history(snapshots: DataFrame) -> DataFrame:
    """(task, seq, column, previous) of snapshots (seq, task, column): where a task's column changes; `(removed)` where it goes."""
    # One row a snapshot: as many as a board's file has commits.
    seqs = snapshots.select("seq").distinct().withColumn("nxt", F.lead("seq").over(Window.orderBy("seq")))
    w = Window.partitionBy("task").orderBy("seq")
    own = snapshots.join(seqs, "seq").withColumn("prev", F.lag("column").over(w)).withColumn("after", F.lead("seq").over(w)).withColumn("pseq_next", F.lag("nxt").over(w))
    back = F.col("pseq_next") != F.col("seq")
    moved = own.filter(F.col("prev").isNull() | (F.col("prev") != F.col("column")) | back).select("task", "seq", "column", F.when(back, "(removed)").otherwise(F.col("prev")).alias("previous"))
    gone = own.filter("nxt is not null and (after is null or after <> nxt)").select("task", F.col("nxt").alias("seq"), F.lit("(removed)").alias("column"), F.col("column").alias("previous"))
    return moved.unionByName(gone)


def snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Snapshot files in order of time; what can't be parsed is left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).orderBy("timestamp")


def write_snapshot(rows: DataFrame, path: str, stamp: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/{stamp}")


def routes(path: str, text: str) -> Iterator[tuple]:
    """(path, line, method, route) of handlers in decorators, routers, and service methods of interface files."""
    for i, ln in enumerate(text.split("\n"), 1):
        if m := re.search(r"@\w+\.(get|post|put|patch|delete)\(\s*[\"']([^\"']+)", ln):
            yield path, i, m[1].upper(), m[2]
        elif m := re.search(r"@\w+\.route\(\s*[\"']([^\"']+)[\"'](?:.*methods\s*=\s*\[\s*[\"'](\w+))?", ln):
            yield path, i, (m[2] or "GET").upper(), m[1]
        elif m := re.search(r"\b(?:app|router)\.(get|post|put|patch|delete)\(\s*[\"'`]([^\"'`]+)", ln):
            yield path, i, m[1].upper(), m[2]
        elif m := re.search(r"^\s*rpc\s+(\w+)\s*\(", ln):
            yield path, i, "RPC", m[1]


def api_routes(files: DataFrame) -> DataFrame:
    return rows_of(files, routes, "path string, line int, method string, route string")


METHODS = ("get", "post", "put", "delete", "patch", "options", "head")


def swagger_routes(path: str, text: str) -> Iterator[tuple]:
    """(path, method, route, summary, tag) of an interface description in YAML, by its indents: paths, their methods, what those say."""
    route, route_indent, method, method_indent, said, tagged = None, 0, None, 0, {}, False

    def done() -> Iterator[tuple]:
        if route and method:
            yield path, method.upper(), route, said.get("summary"), said.get("tag")

    for ln in text.split("\n"):
        body, indent = ln.strip(), len(ln) - len(ln.lstrip())
        if not body or body.startswith("#"):
            continue
        key = re.match(r"""['"]?([^'"]*?)['"]?\s*:\s*$""", body)
        if key and key[1].startswith("/"):
            yield from done()
            route, route_indent, method, said, tagged = key[1], indent, None, {}, False
        elif route and key and key[1].lower() in METHODS and indent > route_indent:
            yield from done()
            method, method_indent, said, tagged = key[1].lower(), indent, {}, False
        elif method and indent > method_indent:
            if m := re.match(r"summary:\s*(.*)", body):
                said.setdefault("summary", m[1].strip("'\""))
                tagged = False
            elif m := re.match(r"tags:\s*(?:\[\s*([^,\]]+).*)?$", body):
                tagged = not m[1]
                if m[1]:
                    said.setdefault("tag", m[1].strip().strip("'\""))
            elif tagged and body.startswith("- "):
                said.setdefault("tag", body[2:].strip().strip("'\""))
                tagged = False
            else:
                tagged = False
    yield from done()


def documented_routes(files: DataFrame) -> DataFrame:
    return rows_of(files, swagger_routes, "path string, method string, route string, summary string, tag string")


def with_documentation(routes: DataFrame, documented: DataFrame) -> DataFrame:
    """Routes (method, route) with the summary and tag that an interface description has for them, and the routes that only it has (source: swagger)."""
    d = documented.groupBy("method", "route").agg(F.min("summary").alias("summary"), F.min("tag").alias("tag"))
    r = routes.select("method", "route").distinct().withColumn("source", F.lit("code"))
    return r.join(d, ["method", "route"], "full_outer").select("method", "route", F.coalesce("source", F.lit("swagger")).alias("source"), "summary", "tag")


def _block(text: str, at: int) -> str:
    """What the braces hold that open at or after a place."""
    start = text.find("{", at)
    depth = 0
    for k in range(start, len(text)) if start >= 0 else ():
        depth += (text[k] == "{") - (text[k] == "}")
        if not depth:
            return text[start + 1 : k]
    return text[start + 1 :] if start >= 0 else ""


def sequelize_rows(path: str, text: str) -> Iterator[tuple]:
    """(path, model, field, type) of `define('Name', {..})` and `Name.init({..})`: fields of the first block, by type or by its `type` entry."""
    found = [(m[1], m.end()) for m in re.finditer(r"\.define(?:<[^(]*>)?\(\s*['\"`](\w+)['\"`]", text)] + [(m[1], m.end() - 1) for m in re.finditer(r"(\w+)\.init\(\s*\{", text)]
    seen = set()
    for model, at in sorted(found, key=lambda x: x[1]):
        if model in seen:
            continue
        seen.add(model)
        body = _block(text, at)
        k = 0
        while m := re.compile(r"(\w+)\s*:\s*(\{|(?:\w+\.)*(\w+)(\([^)]*\))?)").search(body, k):
            if m[2] == "{":
                inner = _block(body, m.start(2))
                t = re.search(r"\btype\s*:\s*(?:\w+\.)*(\w+)", inner)
                yield path, model, m[1], t[1] if t else ""
                k = m.end() + len(inner) + 1
            else:
                yield path, model, m[1], m[3]
                k = m.end()


def drift_rows(path: str, text: str) -> Iterator[tuple]:
    """(path, model, field, type) of table classes: getters whose column type begins the name of their builder."""
    for m in re.finditer(r"(?m)^\s*class\s+(\w+)\s+extends\s+Table\b[^{]*", text):
        for c in re.finditer(r"(\w+)Column\s+get\s+(\w+)\s*=>", _block(text, m.end() - 1)):
            yield path, m[1], c[2], c[1].lower()


def model_rows(path: str, text: str) -> Iterator[tuple]:
    """(path, model, field, type) of classes with columns, schema blocks, structs with tags, messages, and definitions of two libraries of their own."""
    if path.endswith((".js", ".ts", ".mjs")):
        yield from sequelize_rows(path, text)
        return
    if path.endswith(".dart"):
        yield from drift_rows(path, text)
        return
    model, block = None, None
    for ln in text.split("\n"):
        if m := re.match(r"^class\s+(\w+)\s*\([^)]*(?:Model|Base|Table|DeclarativeBase)\b", ln):
            model, block = m[1], "python"
        elif m := re.match(r"^\s*(?:model|message)\s+(\w+)\s*\{", ln):
            model, block = m[1], "block"
        elif m := re.match(r"^type\s+(\w+)\s+struct\s*\{", ln):
            model, block = m[1], "go"
        elif model and block != "python" and re.match(r"^\s*\}", ln):
            model = None
        elif model and block == "python":
            if ln and not ln[0].isspace():
                model = None
            elif m := re.match(r"^\s+(\w+)\s*(?::\s*[^=]+)?=\s*(?:\w+\.)*(?:mapped_column|Column|(\w*Field|ForeignKey))\(\s*(?:\w+\.)*(\w+)?", ln):
                yield path, model, m[1], m[2] or m[3] or ""
        elif model and block == "block":
            if m := re.match(r"^\s*(?:repeated\s+|optional\s+)?([\w.]+)\s+(\w+)\s*=\s*\d+\s*;", ln):
                yield path, model, m[2], m[1]
            elif m := re.match(r"^\s*(\w+)\s+([A-Z]\w*)[?\[\]]*", ln):
                yield path, model, m[1], m[2]
        elif model and block == "go" and (m := re.match(r"^\s*(\w+)\s+([\w.*\[\]]+)", ln)):
            yield path, model, m[1], m[2]


def models(files: DataFrame) -> DataFrame:
    return rows_of(files, model_rows, "path string, model string, field string, type string")


def infra_rows(path: str, text: str) -> Iterator[tuple]:
    """(path, kind, name, detail) of container files, compose services, resources and cluster objects."""
    base = path.rsplit("/", 1)[-1]
    if base.startswith("Dockerfile"):
        for m in re.finditer(r"(?mi)^(FROM|EXPOSE|ENTRYPOINT|CMD)\s+(.+)$", text):
            yield path, "container", m[1].upper(), m[2].strip()
    elif re.match(r"(docker-)?compose.*\.ya?ml$", base):
        body = re.search(r"(?ms)^services:\s*\n(.*?)(?=^\S|\Z)", text)
        name = None
        for ln in (body[1] if body else "").split("\n"):
            if m := re.match(r"^  (\w[\w.-]*):\s*$", ln):
                name = m[1]
                yield path, "service", name, ""
            elif name and (m := re.match(r"^    image:\s*(\S+)", ln)):
                yield path, "image", name, m[1]
    elif base.endswith(".tf"):
        for m in re.finditer(r'(?m)^resource\s+"([^"]+)"\s+"([^"]+)"', text):
            yield path, "resource", m[2], m[1]
    elif base in ("Chart.yaml", "Chart.yml"):
        for m in re.finditer(r"(?m)^(name|version|appVersion):\s*(\S+)", text):
            yield path, "chart", m[1], m[2]
    elif base.endswith((".yaml", ".yml")):
        for doc in re.split(r"(?m)^---\s*$", text):
            kind, name = re.search(r"(?m)^kind:\s*(\S+)", doc), re.search(r"(?m)^metadata:\s*\n(?:\s+.*\n)*?\s+name:\s*(\S+)", doc)
            if kind:
                yield path, "object", name[1] if name else "", kind[1]


def infrastructure(files: DataFrame) -> DataFrame:
    return rows_of(files, infra_rows, "path string, kind string, name string, detail string")


#: Severities of one tool's words; others are low.
NPM_SEVERITY = {"critical": "critical", "high": "high", "moderate": "medium"}


def advisories(path: str, text: str) -> Iterator[tuple]:
    """(path, package, severity, id) of dependency audits' JSON: whole documents, or a document a line."""
    docs = []
    try:
        docs.append(json.loads(text))
    except ValueError:
        for ln in text.split("\n"):
            try:
                docs.append(json.loads(ln))
            except ValueError:
                continue
    for data in docs:
        if isinstance(data, list):
            data = {"dependencies": data}
        if not isinstance(data, dict):
            continue
        vulns = data.get("vulnerabilities")
        if isinstance(vulns, dict) and "list" not in vulns:
            for name, v in vulns.items():
                yield path, name, NPM_SEVERITY.get(str(v.get("severity", "")) if isinstance(v, dict) else "", "low"), ""
        listed = [x for x in vulns.get("list", []) if isinstance(x, dict)] if isinstance(vulns, dict) else []
        for v in [*listed, *([data] if "advisory" in data else [])]:
            found = (v.get("advisory") or {}).get("id") or "RUSTSEC-????"
            yield path, (v.get("package") or {}).get("name") or "unknown", "high" if "RUSTSEC" in found else "medium", found
        if isinstance(data.get("finding"), dict):
            f = data["finding"]
            trace = next((t for t in f.get("trace") or [] if isinstance(t, dict)), {})
            yield path, trace.get("module") or "unknown", "high", f.get("osv") or "GO-????"
        deps = data.get("dependencies")
        for d in (x for x in deps if isinstance(x, dict)) if isinstance(deps, list) else ():
            for v in d.get("vulns") or []:
                yield path, d.get("name") or "unknown", "high", v.get("id") or "CVE-????"


def vulnerabilities(files: DataFrame) -> DataFrame:
    return rows_of(files, advisories, "path string, package string, severity string, id string")
