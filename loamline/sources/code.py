"""Source text as chunks, functions, complexity, imports and call-graph rows.

There is no grammar for most languages here: Python is parsed by its own parser,
other languages by their declarations' patterns and their braces.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from loamline.sources.files import LANGUAGES, rows_of

TARGET, TAIL, LONG, PIECE = 40, 5, 150, 80
#: How a function or class begins, by language.
STARTS = {
    "python": r"^\s*(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(fn|struct|enum|trait|impl)\s+(?:<[^>]*>\s*)?([A-Za-z_]\w*)",
    "go": r"^(func|type)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)",
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(function\*?|class|const|let|var)\s+([A-Za-z_$][\w$]*)(?=\s*(?:\(|\{|extends|=\s*(?:async\s*)?(?:\(|function|\w+\s*=>)))",
    "dart": r"^\s*(class|mixin|[\w<>?,]+)\s+([A-Za-z_]\w*)\s*(?=\(|\{|extends|with)",
}
STARTS |= {"typescript": STARTS["javascript"], "java": r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)+(class|interface|[\w<>\[\]]+)\s+([A-Za-z_]\w*)", "kotlin": r"^\s*(?:\w+\s+)*(fun|class|object)\s+([A-Za-z_]\w*)"}
BRANCHES = r"\b(?:if|elif|for|while|case|catch|except|when|match|and|or)\b|&&|\|\||\?(?=[^?.:]*:)"
IMPORTS = {
    "python": r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))",
    "rust": r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)",
    "go": r"(?m)^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"",
    "javascript": r"(?m)(?:^|\s)(?:import\s+(?:[^'\"]*?from\s+)?|require\()['\"]([^'\"]+)['\"]",
    "dart": r"(?m)^\s*import\s+['\"]([^'\"]+)['\"]",
}
IMPORTS |= {"typescript": IMPORTS["javascript"]}
COMMENT = r"^\s*(#|//|/\*|\*|--|<!--)"


def language_of(path: str) -> str | None:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None


def line_chunks(lines: list[str]) -> list[tuple[int, int]]:
    """Ranges of about 40 lines that end, where they can, at the last blank line from the 30th to the 50th; a tail of under five joins the last."""
    out, at, n = [], 0, len(lines)
    while at < n:
        end = min(at + TARGET, n)
        if end < n:
            blank = [i for i in range(at + TARGET - 10, min(at + TARGET + 10, n)) if not lines[i].strip()]
            end = blank[-1] + 1 if blank else end
        if out and n - at < TAIL:
            out[-1] = (out[-1][0], n)
            break
        out.append((at, end))
        at = end
    return out


def functions(text: str, lang: str | None) -> list[tuple[str, str, int, int]]:
    """(kind, name, first line, last line) of outer declarations, from 1."""
    start = re.compile(STARTS[lang]) if lang in STARTS else None
    if not start:
        return []
    lines, out, depth = text.split("\n"), [], 0
    for i, ln in enumerate(lines):
        m = start.match(ln)
        shallow = (len(ln) - len(ln.lstrip())) <= 4 if lang == "python" else depth <= 1
        if m and shallow:
            out.append([m[1], m[2], i + 1, len(lines)])
            if len(out) > 1:
                out[-2][3] = i
        if lang != "python":
            depth = max(0, depth + ln.count("{") - ln.count("}"))
    return [tuple(x) for x in out]


def chunk(path: str, text: str) -> Iterator[tuple]:
    """(path, chunk, line_start, line_end, text): a chunk a function, long ones in pieces; text without functions by lines.  Each begins with its path."""
    lines = text.split("\n")
    found = functions(text, language_of(path))
    spans: list[tuple[int, int, str]] = []
    if found:
        first = found[0][2] - 1
        if sum(bool(x.strip()) for x in lines[:first]) >= 3:
            spans.append((0, first, ""))
        for _, _, a, b in found:
            if b - a + 1 <= LONG:
                spans.append((a - 1, b, ""))
            else:
                for k in range(a - 1, b, PIECE):
                    spans.append((k, min(k + PIECE, b), "" if k == a - 1 else lines[a - 1] + "  (continued)\n"))
    else:
        spans = [(a, b, "") for a, b in line_chunks(lines)]
    for k, (a, b, head) in enumerate(spans):
        yield path, k, a + 1, b, f"// {path}\n{head}" + "\n".join(lines[a:b])


def chunks(files: DataFrame) -> DataFrame:
    return rows_of(files, chunk, "path string, chunk int, line_start int, line_end int, text string")


def complexity_rows(path: str, text: str) -> Iterator[tuple]:
    """(path, name, line, complexity, loc) of each function: one more than its branches, comments aside."""
    lines = text.split("\n")
    for kind, name, a, b in functions(text, language_of(path)):
        if kind in ("class", "struct", "enum", "trait", "impl", "interface", "type", "mixin"):
            continue
        body = [x for x in lines[a - 1 : b] if not re.match(COMMENT, x)]
        yield path, name, a, 1 + sum(len(re.findall(BRANCHES, x)) for x in body[1:]), sum(bool(x.strip()) for x in body)


def complexity(files: DataFrame) -> DataFrame:
    return rows_of(files, complexity_rows, "path string, name string, line int, complexity int, loc int")


def module_row(path: str, text: str) -> Iterator[tuple]:
    """(path, language, loc, classes, functions, imports)."""
    lang = language_of(path)
    found = functions(text, lang)
    classes = sum(k in ("class", "struct", "trait", "interface") for k, *_ in found)
    names = [next(g for g in m.groups() if g) for m in re.finditer(IMPORTS[lang], text)] if lang in IMPORTS else []
    yield path, lang, sum(bool(x.strip()) for x in text.split("\n")), classes, len(found) - classes, list(dict.fromkeys(names))


def modules(files: DataFrame) -> DataFrame:
    return rows_of(files, module_row, "path string, language string, loc int, classes int, functions int, imports array<string>")


def is_test(name: str, path: str) -> bool:
    return name.startswith(("test_", "Test")) or name.endswith("_test") or bool(re.search(r"(^|/)tests?/|(^|/)test_|_test\.|\.(test|spec)\.", path))


def graph_rows(path: str, text: str) -> Iterator[tuple]:
    """Vertices and edges of a file in one list: (row, kind, a, b, path, line_start, line_end, parent, is_test); a vertex's b is its name."""
    lang = language_of(path)
    yield "node", "File", path, path.rsplit("/", 1)[-1], path, 1, text.count("\n") + 1, None, False
    if lang == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return
        held: list[tuple[ast.AST, str | None, str]] = [(tree, None, path)]
        while held:
            node, parent, owner = held.pop()
            for child in ast.iter_child_nodes(node):
                here, up = owner, parent
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    is_class = isinstance(child, ast.ClassDef)
                    here = "::".join(x for x in (path, parent, child.name) if x)
                    yield "node", "Class" if is_class else "Test" if is_test(child.name, path) else "Function", here, child.name, path, child.lineno, child.end_lineno or child.lineno, parent, is_test(child.name, path)
                    yield "edge", "CONTAINS", owner, here, path, child.lineno, None, None, False
                    up = child.name if is_class else parent
                elif isinstance(child, ast.Call):
                    f = child.func
                    target = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                    if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id[:1].isupper():
                        target = f"{f.value.id}::{f.attr}"
                    if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "self" and parent:
                        target = f"{path}::{parent}::{f.attr}"
                    if target:
                        yield "edge", "CALLS", owner, target, path, child.lineno, None, None, False
                elif isinstance(child, ast.Import):
                    for a in child.names:
                        yield "edge", "IMPORTS_FROM", path, a.name, path, child.lineno, None, None, False
                elif isinstance(child, ast.ImportFrom):
                    yield "edge", "IMPORTS_FROM", path, "." * child.level + (child.module or ""), path, child.lineno, None, None, False
                held.append((child, up, here))
        return
    for kind, name, a, b in functions(text, lang):
        qn = f"{path}::{name}"
        yield "node", "Class" if kind in ("class", "struct", "trait", "interface") else "Function", qn, name, path, a, b, None, is_test(name, path)
        yield "edge", "CONTAINS", path, qn, path, a, None, None, False
        for k, ln in enumerate(text.split("\n")[a:b], a + 1):
            if not re.match(COMMENT, ln):
                for t in re.findall(r"\b((?:[A-Z]\w*::)?[A-Za-z_]\w*)\s*\(", ln):
                    if t not in ("if", "for", "while", "match", "switch", "return", "fn", "func", "function", "catch"):
                        yield "edge", "CALLS", qn, t, path, k, None, None, False
    for m in re.finditer(IMPORTS[lang], text) if lang in IMPORTS else ():
        yield "edge", "IMPORTS_FROM", path, next(g for g in m.groups() if g), path, text.count("\n", 0, m.start()) + 1, None, None, False


def call_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) in the columns that the graph operators take."""
    rows = rows_of(files, graph_rows, "row string, kind string, a string, b string, path string, line_start int, line_end int, parent string, is_test boolean")
    n = rows.filter("row = 'node'").selectExpr("kind", "b as name", "a as qualified_name", "path as file_path", "line_start", "line_end", "parent as parent_name", "is_test")
    e = rows.filter("row = 'edge'").selectExpr("kind", "a as source_qualified", "b as target_qualified", "path as file_path", "line_start as line")
    return n, e
