"""Scalar helpers that queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_two_parts(path: Column) -> Column:
    """The last two parts of a path, as a short label."""
    p = F.split(path, "/")
    return F.when(F.size(p) > 1, F.concat_ws("/", F.element_at(p, -2), F.element_at(p, -1))).otherwise(path)


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def safe_id(s: Column) -> Column:
    """Letters, digits and underscores; anything else is an underscore."""
    return F.regexp_replace(s, "[^A-Za-z0-9_]", "_")


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def truncated(s: Column, n: int) -> Column:
    """At most n characters, the last three of a cut text being dots."""
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 3), F.lit("..."))).otherwise(s)


def marker_hash(kind: Column, file: Column, text: Column) -> Column:
    """Eight hex digits that name a marker by kind, file and text."""
    return F.substring(F.sha2(F.concat_ws("|", kind, file, text), 256), 1, 8)


def url_in(s: Column) -> Column:
    """The first local or web address in a line, with 0.0.0.0 as localhost; null where there is none."""
    u = F.regexp_extract(s, r"(https?://[^\s\"'<>]+)", 1)
    return F.when(u != "", F.replace(u, F.lit("0.0.0.0"), F.lit("localhost")))


def age(days: Column) -> Column:
    return F.when(days < 1, "today").when(days < 2, "yesterday").when(days < 30, F.concat(days.cast("int").cast("string"), F.lit(" days ago"))).otherwise(F.concat(F.floor(days / 30).cast("int").cast("string"), F.lit(" months ago")))


def due(last: Column, now: Column, every_days: int) -> Column:
    """Whether something that should happen every so many days is due; never done is due."""
    return F.coalesce(F.datediff(now, last) >= every_days, F.lit(True))


def priority(kind: Column) -> Column:
    return F.when(kind.isin("FIXME", "BUG"), "high").when(kind.isin("HACK", "XXX"), "medium").otherwise("low")


def service_type(port: Column) -> Column:
    """What usually listens on a port."""
    return F.when(port.isin(5432, 3306, 27017, 1433), "database").when(port.isin(6379, 11211), "cache").when(port.isin(5672, 9092), "queue").when(port.between(3000, 3999) | port.between(5173, 5179), "frontend").when(port.between(8000, 8999), "backend").otherwise("unknown")


def exported(name: Column, language: Column) -> Column:
    """Whether a name can be used from other modules."""
    return F.when(language == "go", name.rlike("^[A-Z]")).when(language.isin("python", "dart"), ~name.startswith("_")).otherwise(F.lit(True))
