"""Coverage reports as (file, total, hit)."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.sources.files import rows_of

ROW = "report string, file string, total long, hit long"


def lcov(path: str, text: str) -> Iterator[tuple]:
    file, total, hit = "", 0, 0
    for ln in text.split("\n"):
        key, _, value = ln.strip().partition(":")
        if key == "SF":
            file, total, hit = value, 0, 0
        elif key == "LF":
            total = int(value or 0)
        elif key == "LH":
            hit = int(value or 0)
        elif key == "end_of_record" and file:
            yield path, file, total, hit
            file = ""


def cobertura(path: str, text: str) -> Iterator[tuple]:
    """Lines of each class; of a class without lines a hundred at its rate; of a report without classes its totals."""
    root = ET.fromstring(text)
    seen = False
    for c in root.iter("class"):
        seen = True
        lines = c.findall("./lines/line")
        name = c.get("filename") or c.get("name") or ""
        if lines:
            yield path, name, len(lines), sum(int(x.get("hits", "0")) > 0 for x in lines)
        else:
            yield path, name, 100, round(100 * float(c.get("line-rate", "0")))
    if not seen and root.get("lines-valid"):
        yield path, "", int(root.get("lines-valid", "0")), int(root.get("lines-covered", "0"))


def istanbul(path: str, text: str) -> Iterator[tuple]:
    """A summary (lines by file), or a final report (statements counted)."""
    for name, v in json.loads(text).items():
        if name == "total" or not isinstance(v, dict):
            continue
        if "lines" in v:
            yield path, name, int(v["lines"].get("total", 0)), int(v["lines"].get("covered", 0))
        elif "s" in v:
            yield path, name, len(v["s"]), sum(n > 0 for n in v["s"].values())


def go_cover(path: str, text: str) -> Iterator[tuple]:
    got: dict[str, list[int]] = {}
    for m in re.finditer(r"(?m)^(\S+):\d+\.\d+,\d+\.\d+ (\d+) (\d+)$", text):
        t = got.setdefault(m[1], [0, 0])
        t[0] += int(m[2])
        t[1] += int(m[2]) if int(m[3]) > 0 else 0
    for file, (total, hit) in got.items():
        yield path, file, total, hit


def tarpaulin(path: str, text: str) -> Iterator[tuple]:
    for f in json.loads(text).get("files", []):
        p = f.get("path", "")
        yield path, "/".join(p) if isinstance(p, list) else p, int(f.get("coverable", 0)), int(f.get("covered", 0))


#: Where reports are looked for, the first with rows wins.
PLACES = (("lcov.info", lcov), ("coverage/lcov.info", lcov), ("coverage.lcov", lcov), ("coverage.xml", cobertura), ("cobertura.xml", cobertura), ("coverage/cobertura-coverage.xml", cobertura), ("coverage/coverage-summary.json", istanbul), ("coverage/coverage-final.json", istanbul), ("coverage.out", go_cover), ("cover.out", go_cover), ("tarpaulin-report.json", tarpaulin))


def parse(path: str, text: str) -> Iterator[tuple]:
    for place, f in PLACES:
        if path == place or path.endswith("/" + place):
            try:
                yield from f(path, text)
            except (ValueError, ET.ParseError, AttributeError, TypeError):
                return
            return


def reports(files: DataFrame) -> DataFrame:
    """All reports' rows.  Malformed reports have none."""
    return rows_of(files, parse, ROW)


def first_report(rows: DataFrame) -> DataFrame:
    """The rows of the report at the first place."""
    rank = F.coalesce(*[F.when((F.col("report") == p) | F.col("report").endswith("/" + p), i) for i, (p, _) in enumerate(PLACES)])
    best = rows.agg(F.min(F.struct(rank.alias("rank"), "report")).alias("m")).select(F.col("m.report").alias("report"))
    return rows.join(F.broadcast(best), "report", "left_semi")
