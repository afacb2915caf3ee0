"""API contracts: normalised paths, producers and consumers, drift; names across projects; inferred keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rest_path(url: Column) -> Column:
    """A URL's path in small letters, without scheme, host, query and trailing slash; numbers and {names} are {param}."""
    p = F.regexp_replace(F.lower(url), r"^[a-z]+://[^/?#]*", "")
    p = F.regexp_replace(p, r"[?#].*$", "")
    p = F.regexp_replace(p, r"/+$", "")
    p = F.regexp_replace(p, r"/(\d+|:[a-z_]\w*|\{[^}/]*\}|<[^>/]*>)(?=/|$)", "/{param}")
    return F.when(p == "", "/").otherwise(p)


def url_host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z]+://([^/:?#]*)", 1)


def exact_links(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(key, producer, consumer) of equal keys."""
    return consumers.join(producers, "key").select("key", "producer", "consumer").distinct()


def param_links(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(producer_key, consumer_key) that differ and match segment by segment, {param} matching anything, with one concrete segment alike.

    Joined on the number of segments and on each concrete segment that both can agree in, so never all against all.
    """
    def parts(df: DataFrame, name: str) -> DataFrame:
        s = F.split(F.col("key"), "/")
        out = df.select("key").distinct().select(F.col("key").alias(name), s.alias(f"{name}_s"), F.size(s).alias("n"))
        return out.select(name, f"{name}_s", "n", F.posexplode(f"{name}_s").alias("at", "seg")).filter("seg <> '' and seg <> '{param}'")

    a, b = parts(producers, "producer_key"), parts(consumers, "consumer_key")
    both = a.join(b, ["n", "at", "seg"]).select("producer_key", "consumer_key", "producer_key_s", "consumer_key_s").distinct().filter("producer_key <> consumer_key")
    same = F.forall(F.zip_with("producer_key_s", "consumer_key_s", lambda x, y: (x == y) | (x == "{param}") | (y == "{param}")), lambda ok: ok)
    return both.filter(same).select("producer_key", "consumer_key")


def drift(producers: DataFrame, consumers: DataFrame, service: Column) -> DataFrame:
    """(key, status): consumed keys that are matched, that a known service doesn't offer (violation), or that no one knows (external)."""
    c = consumers.select("key").distinct().withColumn("service", service)
    p = producers.select("key").distinct()
    s = p.withColumn("service", service).select("service").distinct().withColumn("known", F.lit(True))
    out = c.join(p.withColumn("hit", F.lit(True)), "key", "left").join(s, "service", "left")
    return out.select("key", F.when(F.col("hit"), "matched").when(F.col("known"), "violation").otherwise("external").alias("status"))


def normal_name(name: Column) -> Column:
    """Package names compare without case and with `_` as `-`."""
    return F.regexp_replace(F.lower(name), "_", "-")


def cross_project(dependencies: DataFrame, packages: DataFrame) -> DataFrame:
    """(project, dependency, target) of dependencies that are another project's package."""
    d = dependencies.withColumn("k", normal_name(F.col("dependency")))
    p = packages.select(F.col("project").alias("target"), normal_name(F.col("package")).alias("k"))
    return d.join(p, "k").filter("project <> target").select("project", "dependency", "target").distinct()


def unmatched(dependencies: DataFrame, packages: DataFrame) -> DataFrame:
    d = dependencies.withColumn("k", normal_name(F.col("dependency")))
    return d.join(packages.select(normal_name(F.col("package")).alias("k")), "k", "left_anti").select("dependency").distinct()


def infer_keys(fields: DataFrame, models: DataFrame) -> DataFrame:
    """(model, field, target): a field less its key suffix names a model, its plural, or its singular; never its own."""
    base = F.lower(F.regexp_replace("field", r"(_id|Id|_key|key)$", ""))
    f = fields.filter(F.col("field").rlike(r"(_id|Id|_key|key)$")).withColumn("base", base)
    m = models.select(F.col("model").alias("target"), F.lower("model").alias("name"))
    options = F.array(F.col("base"), F.concat("base", F.lit("s")), F.regexp_replace("base", "s$", ""))
    hit = f.select("model", "field", F.posexplode(options).alias("rank", "name")).join(m, "name").filter("model <> target")
    return hit.groupBy("model", "field").agg(F.min(F.struct("rank", "target")).alias("m")).select("model", "field", "m.target")


def full_outer_fill(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows of either side; nulls of the left are filled from the right."""
    r = right.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    return left.join(r, key, "full_outer").select(*key, *[F.coalesce(c, f"_{c}").alias(c) for c in columns])


def longest_prefix(paths: DataFrame, prefixes: DataFrame, path: str, prefix: str) -> DataFrame:
    """Each path with the longest prefix of it, joined by equality on every folder that a path is in."""
    parts = F.split(F.col(path), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    up = paths.select(path, F.explode(ups).alias(prefix)).join(prefixes.select(prefix).distinct(), prefix)
    best = up.groupBy(path).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return paths.join(best, path, "left")


def first_existing(imports: DataFrame, modules: DataFrame, key: list[str], candidates: str, module: str) -> DataFrame:
    """Each import with the first of its candidate paths that is a module; null if none is."""
    c = imports.select(*key, F.posexplode(candidates).alias("rank", module))
    hit = c.join(modules.select(module).distinct(), module).groupBy(*key).agg(F.min(F.struct("rank", module)).alias("m"))
    return imports.join(hit, key, "left").select(*key, F.col(f"m.{module}").alias("resolved"))


def suffix_join(rows: DataFrame, named: DataFrame, path: str, suffix: str, keep: list[str]) -> DataFrame:
    """Left join on one path ending with the other at a folder's edge: by equality on every suffix that a path has."""
    parts = F.split(F.col(path), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    hit = rows.select(path, F.explode(ends).alias(suffix)).join(named, suffix).groupBy(path).agg(F.max_by(F.struct(suffix, *keep), F.length(suffix)).alias("m"))
    return rows.join(hit, path, "left").select(*rows.columns, *[F.col(f"m.{c}").alias(c) for c in keep])


def priority_pick(rows: DataFrame, key: list[str], priority: Column) -> DataFrame:
    """One row of each key: the first by priority, then by all columns."""
    w = Window.partitionBy(*key).orderBy(priority, *rows.columns)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
