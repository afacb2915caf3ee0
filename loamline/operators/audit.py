"""Rule-based findings over lines of text: rules as data, suppression, severity by context."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.operators.retrieval import glob_regex


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str
    pattern: str
    unless: str | None = None
    #: Words in small letters of which every match has one: looked for before the pattern.
    words: tuple[str, ...] = ()


#: Secrets: our own patterns for the usual twelve families of credentials.
SECRET_RULES = (
    Rule("secret-aws", "HardcodedSecret", "critical", r"\bAKIA[0-9A-Z]{16}\b", words=("akia",)),
    Rule("secret-github", "HardcodedSecret", "critical", r"\bgh[pousr]_[A-Za-z0-9]{36}\b", words=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("secret-stripe", "HardcodedSecret", "critical", r"\b[sr]k_(live|test)_[A-Za-z0-9]{16,}", words=("sk_live", "sk_test", "rk_live", "rk_test")),
    Rule("secret-jwt", "HardcodedSecret", "high", r"(?i)jwt_?secret\s*[:=]\s*[\"'][^\"']{8,}[\"']", words=("jwt",)),
    Rule("secret-db-url", "HardcodedSecret", "critical", r"\b(postgres|postgresql|mysql|mongodb|redis)://[^\s:@/]+:[^\s@/]+@", words=("://",)),
    Rule("secret-google", "HardcodedSecret", "high", r"\bAIza[0-9A-Za-z_-]{35}", words=("aiza",)),
    Rule("secret-slack", "HardcodedSecret", "high", r"\bxox[abprs]-[0-9A-Za-z-]{10,}", words=("xox",)),
    Rule("secret-sendgrid", "HardcodedSecret", "high", r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", words=("sg.",)),
    Rule("secret-private-key", "HardcodedSecret", "critical", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", words=("-----begin",)),
    Rule("secret-api-key", "HardcodedSecret", "high", r"(?i)api[_-]?key\s*[:=]\s*[\"'][^\"']{8,}[\"']", words=("api",)),
    Rule("secret-password", "HardcodedSecret", "high", r"(?i)(password|passwd|pwd)\s*[:=]\s*[\"'][^\"']{4,}[\"']", words=("pass", "pwd")),
    Rule("secret-token", "HardcodedSecret", "high", r"(?i)\b(token|secret)\s*[:=]\s*[\"'][^\"']{8,}[\"']", words=("token", "secret")),
)

CODE_RULES = (
    Rule("sqli-fstring", "SqlInjection", "high", r"(?i)f[\"'](select|insert|update|delete)\b.*\{", words=("select", "insert", "update", "delete")),
    Rule("sqli-concat", "SqlInjection", "high", r"(?i)execute\(\s*[\"'].*[\"']\s*(\+|%)", words=("execute(",)),
    Rule("cmdi-shell", "CommandInjection", "critical", r"subprocess\.\w+\(.*shell\s*=\s*True", words=("subprocess.",)),
    Rule("cmdi-system", "CommandInjection", "critical", r"\bos\.(system|popen)\s*\(", words=("os.",)),
    Rule("cmdi-eval", "CommandInjection", "critical", r"(^|[^.\w])(eval|exec)\s*\(", words=("eval", "exec")),
    Rule("pathtr-open", "PathTraversal", "high", r"\b(open|send_file|sendFile)\s*\(\s*(request|req|params)\b", words=("open", "send")),
    Rule("deser-yaml", "InsecureDeserialization", "high", r"\byaml\.load\s*\(", r"SafeLoader", words=("yaml.load",)),
    Rule("deser-pickle", "InsecureDeserialization", "high", r"\bpickle\.loads?\s*\(", words=("pickle.",)),
    Rule("crypto-hash", "WeakCryptography", "medium", r"(?i)\b(md5|sha1)\s*\(", words=("md5", "sha1")),
    Rule("xss-inner", "XssVulnerability", "high", r"\binnerHTML\s*=[^=]", words=("innerhtml",)),
    Rule("xss-write", "XssVulnerability", "high", r"\bdocument\.write\s*\(", words=("document.write",)),
    Rule("xss-script", "XssVulnerability", "medium", r"<script>\s*var\b", words=("<script>",)),
    Rule("debug-flask", "InsecureConfig", "medium", r"\bdebug\s*=\s*True", words=("debug",)),
    Rule("cors-open", "InsecureConfig", "medium", r"Access-Control-Allow-Origin\W+\*", words=("access-control",)),
    Rule("bind-all", "InsecureConfig", "low", r"\b0\.0\.0\.0\b", words=("0.0.0.0",)),
    Rule("err-bare", "UnsafeErrorHandling", "high", r"^\s*except\s*:", words=("except",)),
    Rule("err-unwrap", "UnsafeErrorHandling", "medium", r"\.unwrap\(\)", words=(".unwrap()",)),
    Rule("err-discard", "UnsafeErrorHandling", "medium", r"\b_\s*(,\s*_\s*)?:?=\s*\w+\(", words=("_",)),
    Rule("pii-email", "PersonalData", "low", r"\b[A-Za-z0-9._]+@[A-Za-z0-9.-]+\.[a-z]{2,}\b", words=("@",)),
    Rule("license-nc", "License", "info", r"(?i)licensed under cc by-nc", words=("licensed under",)),
)


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(file, line, content), lines from 1."""
    parts = df.select(F.col(id_col).alias("file"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("p", "content"))
    return parts.select("file", (F.col("p") + 1).alias("line"), "content")


def near_lines(df: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(file, line, content) of the lines, from 1, that have a word of a rule: all that a rule can meet.

    All words are looked for at once, by one automaton over whole batches, before lines become rows.
    """
    if not all(r.words for r in rules):
        return lines(df, id_col, text_col).withColumn("line", F.col("line").cast("long"))
    words = "(?i)" + "|".join(re.sub(r"([^A-Za-z0-9_])", r"\\\1", w) for w in sorted({w for r in rules for w in r.words}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                b = batch.slice(at, 512)
                parts = pc.split_pattern(b.column(1), b"\n")
                row, content = pc.list_parent_indices(parts), pc.list_flatten(parts)
                hit = pa.array(np.flatnonzero(pc.match_substring_regex(content, words).to_numpy(zero_copy_only=False)))
                row = row.to_numpy()
                line = np.arange(len(row)) - np.searchsorted(row, row) + 1
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row).take(hit)), pa.array(line).take(hit), content.take(hit)], names=["file", "line", "content"])

    rows = df.select(F.col(id_col).alias("file"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    found = rows.mapInArrow(run, f"file {rows.schema['file'].dataType.simpleString()}, line long, content binary")
    return found.select("file", "line", F.col("content").cast("string").alias("content"))


def findings(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(file, line, rule, category, severity): one row for each rule that a line meets.  One pass; rules are an array of matches, a rule's words are looked for before its pattern."""
    rows, hits = rows.withColumn("_low", F.lower("content")), []
    for r in rules:
        near = F.lit(not r.words)
        for w in r.words:
            near = near | F.col("_low").contains(w)
        cond = near & F.col("content").rlike(r.pattern)
        if r.unless:
            cond = cond & ~F.col("content").rlike(r.unless)
        hits.append(F.when(cond, F.struct(F.lit(r.id).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"))))
    found = rows.withColumn("hit", F.array_compact(F.array(*hits))).filter(F.size("hit") > 0)
    return found.select("file", "line", F.explode("hit").alias("h")).select("file", "line", "h.*")


def suppress(found: DataFrame, rows: DataFrame, rules: list[tuple[str, str]], path: Column) -> DataFrame:
    """Findings that no (rule or category glob, path glob) and no comment silences.

    A comment `lint:ignore-file` in the first five lines silences its file, `lint:ignore-next-line` the line after it.
    """
    w = Window.partitionBy("file").orderBy("line")
    marks = rows.select("file", "line", F.lag(F.col("content").contains("lint:ignore-next-line")).over(w).alias("skip"))
    whole = rows.filter("line <= 5").filter(F.col("content").contains("lint:ignore-file")).select("file").distinct()
    kept = found.join(whole, "file", "left_anti").join(marks.filter("skip").select("file", "line"), ["file", "line"], "left_anti")
    silent = F.lit(False)
    for what, where in rules:
        silent = silent | ((F.col("rule").rlike(glob_regex(what)) | F.col("category").rlike(glob_regex(what))) & path.rlike(glob_regex(where)))
    return kept.filter(~silent)


def in_context(severity: Column, category: Column, role: Column, is_test: Column, is_const: Column) -> tuple[Column, Column]:
    """(severity, confidence) of a finding where it stands; the first rule that fits decides."""
    errors, crypto = category == "UnsafeErrorHandling", category.isin("WeakCrypto", "WeakCryptography")
    rules = [
        (errors & is_const, "info", "certain"),
        (errors & is_test, "info", "certain"),
        ((category == "HardcodedSecret") & is_test, "low", "probable"),
        (crypto & (role == "i18n"), "info", "certain"),
        (role == "generated", "info", "certain"),
        (category == "DependencyVulnerability", None, "certain"),
        (errors & (role == "audit_pattern"), "info", "probable"),
    ]
    sev, conf = severity, F.lit("heuristic")
    for cond, s, c in reversed(rules):
        sev = F.when(cond, severity if s is None else F.lit(s)).otherwise(sev)
        conf = F.when(cond, F.lit(c)).otherwise(conf)
    return sev, conf


#: Markers of explicit debt, in the order in which they are looked for.
DEBT_MARKERS = ("TODO", "FIXME", "HACK", "XXX", "OPTIMIZE", "BUG", "TEMP", "WORKAROUND")


def explicit_debt(rows: DataFrame) -> DataFrame:
    """(file, line, kind, text) of lines with a marker that begins a word, the first in the markers' order."""
    kind = F.coalesce(*[F.when(F.col("content").rlike(rf"(^|[^A-Za-z0-9_]){m}"), m) for m in DEBT_MARKERS])
    out = rows.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    return out.select("file", "line", "kind", F.trim(F.expr("regexp_replace(substring(content, instr(content, kind) + length(kind)), '^[:\\\\s-]+', '')")).alias("text"))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1b\[[0-9;?]*[A-Za-z]", "")


def is_progress(text: Column) -> Column:
    """Progress bars, spinners and percentages alone."""
    return text.rlike(r"^\s*\d{1,3}(\.\d+)?%\s*$") | text.rlike(r"^\s*\[[=#>. -]+\]") | text.rlike(r"^\s*[|/\\-]\s*$") | text.rlike(r"^[\s█▓▒░▏▎▍▌▋▊▉=>#.-]{5,}$")


def log_level(text: Column) -> Column:
    u = F.upper(text)
    return F.when(u.rlike(r"\b(ERROR|FATAL|PANIC)\b"), "error").when(u.rlike(r"\bWARN(ING)?\b"), "warn").when(u.rlike(r"\bINFO\b"), "info").when(u.rlike(r"\bDEBUG\b"), "debug").when(u.rlike(r"\bTRACE\b"), "trace")
