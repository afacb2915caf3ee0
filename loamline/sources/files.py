"""Corpus scans: which files are read, in what language, and rows from each file's text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Languages by file extension; folders that hold nothing of one's own; names that may hold credentials.
LANGUAGES = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "dart": "dart", "java": "java", "kt": "kotlin", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "swift": "swift", "verse": "verse", "sql": "sql", "proto": "proto", "md": "markdown", "yaml": "yaml", "yml": "yaml", "toml": "toml", "json": "json", "html": "html", "css": "css", "sh": "shell"}
SKIP_DIRS = ("node_modules", "target", "dist", "build", ".git", "__pycache__", ".venv", "venv", "vendor", ".next", ".dart_tool", "coverage")
GENERATED = (".min.js", ".min.css", ".g.dart", ".freezed.dart", ".pb.go", "_pb2.py", ".generated.ts", ".lock")
# Extensions and whole names of files that may hold credentials.
SENSITIVE_EXTENSIONS = ("pem", "key", "p12", "pfx", "jks", "keystore", "crt", "cer", "der", "p7b")
SENSITIVE_FILENAMES = (".env", ".env.local", ".env.production", ".env.staging", ".env.development", ".env.test", "credentials.json", "service-account.json", "secrets.yaml", "secrets.yml", "secrets.json", "secrets.toml", ".npmrc", ".pypirc", ".netrc", ".htpasswd", "id_rsa", "id_ed25519", "id_ecdsa", "id_dsa", "known_hosts", "authorized_keys", ".pgpass", "token.json")
TEST_PATH = r"(^|/)(tests?|__tests__|spec)/|(^|/)(test_[^/]*|[^/]*_test\.[^/]*|[^/]*\.(test|spec)\.[^/]*)$"


def relative(path: Column, root: str) -> Column:
    bare = root.split(":", 1)[-1].rstrip("/").lstrip("/")
    return F.regexp_replace(path, rf"^.*?{bare and '/' + bare or ''}/", "") if bare else path


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """The language of a path's extension; null where it is none of ours."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, extension(path))


def is_sensitive(path: Column) -> Column:
    """Whether a path's name, or what follows its last dot, stands for credentials.  A dot that begins a name begins no extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return name.isin(*SENSITIVE_FILENAMES) | F.regexp_extract(name, r"^.+\.([^.]+)$", 1).isin(*SENSITIVE_EXTENSIONS)


def is_generated(path: Column) -> Column:
    hit = F.lit(False)
    for s in GENERATED:
        hit = hit | path.endswith(s)
    return hit


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def ignored(path: Column, patterns: list[str]) -> Column:
    """Ignore rules: `*x` is an ending, `x/` a folder anywhere, anything else a beginning; blank lines and comments are none."""
    hit = F.lit(False)
    for p in (p.strip() for p in patterns):
        if not p or p.startswith("#"):
            continue
        if p.startswith("*"):
            hit = hit | path.endswith(p[1:])
        elif p.endswith("/"):
            hit = hit | path.startswith(p) | path.contains("/" + p)
        else:
            hit = hit | path.startswith(p)
    return hit


def scan(spark: SparkSession, root: str, languages: Iterable[str] | None = None, depth: int = 8, most_bytes: int = 1 << 20, ignore: list[str] | None = None, sensitive: bool = False, glob: str | None = None) -> DataFrame:
    """(path, text, bytes, language) of the text files below a root: no deeper, no larger, not generated, not ignored.

    Listing and size limits apply before contents are read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    f = reader.load(root).filter(F.col("length") <= most_bytes).withColumn("path", relative(F.col("path"), root))
    parts = F.split("path", "/")
    keep = (F.size(parts) <= depth) & ~F.arrays_overlap(parts, F.array(*[F.lit(s) for s in SKIP_DIRS])) & ~is_generated(F.col("path")) & ~ignored(F.col("path"), ignore or [])
    if not sensitive:
        keep = keep & ~is_sensitive(F.col("path"))
    f = f.filter(keep).withColumn("language", language(F.col("path")))
    if languages is not None:
        f = f.filter(F.col("language").isin(*languages))
    return f.select("path", F.col("content").cast("string").alias("text"), F.col("length").alias("bytes"), "language")


# What goes into the index: extensions (or whole names), folders that don't, ends and names of generated files, most bytes, folders deep.
INDEX_EXTENSIONS = ("rs", "go", "py", "js", "ts", "tsx", "jsx", "java", "kt", "swift", "dart", "c", "cpp", "h", "hpp", "cs", "rb", "php", "lua", "zig", "ex", "exs", "vue", "svelte", "astro", "proto", "sql", "md", "dockerfile", "verse")
INDEX_SKIP_DIRS = ("node_modules", "target", "__pycache__", "dist", "build", ".git", "vendor", ".venv", "venv", ".env", ".next", ".nuxt", ".dart_tool", ".turbo", "coverage", "Intermediate", "Saved", "Binaries", "DerivedDataCache")
INDEX_GENERATED = (".pb.rs", "_pb2.py", ".pb.go", ".g.dart", ".freezed.dart", ".gen.go")
INDEX_GENERATED_NAMES = ("lcov.info", "coverage.xml")
INDEX_BYTES, INDEX_DEPTH = 500_000, 6


def is_indexable(path: Column) -> Column:
    """Whether a relative path is one for the index: of a kind, not hidden, generated, sensitive or below a folder that isn't one's own, and not too deep."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    kind = F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1)).isin(*INDEX_EXTENSIONS) | F.lower(name).isin(*INDEX_EXTENSIONS)
    own = ~F.exists(parts, lambda p: p.startswith(".") | p.isin(*INDEX_SKIP_DIRS)) & (F.size(parts) <= INDEX_DEPTH)
    made = name.isin(*INDEX_GENERATED_NAMES)
    for end in INDEX_GENERATED:
        made = made | name.endswith(end)
    return kind & own & ~made & ~is_sensitive(path)


def indexable(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, text, bytes, language) of the files that the index holds; sizes and names are looked at before contents."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= INDEX_BYTES).withColumn("path", relative(F.col("path"), root))
    f = f.filter(is_indexable(F.col("path")) & ~ignored(F.col("path"), ignore or []))
    return f.select("path", F.col("content").cast("string").alias("text"), F.col("length").alias("bytes"), language(F.col("path")).alias("language"))


def hidden(spark: SparkSession, root: str, name: str, depth: int = 3) -> DataFrame:
    """(path, text) of settings files that Spark's listing leaves out (names that begin with a dot), by a name pattern, to a depth.

    There are a few of them in a project and they are small: the driver reads them through the file system's own client.
    """
    jvm = spark.sparkContext._jvm
    ups = ",".join("*/" * k + name for k in range(depth))
    glob = jvm.org.apache.hadoop.fs.Path(f"{root}/{{{ups}}}")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob)
    read = jvm.org.apache.commons.io.IOUtils.toString
    got = []
    for f in found or []:
        if f.isFile():
            stream = glob.getFileSystem(spark._jsc.hadoopConfiguration()).open(f.getPath())
            got.append((f.getPath().toString(), read(stream, "UTF-8")))
            stream.close()
    return spark.createDataFrame(got, "path string, text string").select(relative(F.col("path"), root).alias("path"), "text")


def dominant_language(files: DataFrame) -> DataFrame:
    """One row: the language of most files; of equals the first by the fixed order."""
    order = ("verse", "dart", "python", "typescript", "javascript", "go", "rust")
    rank = F.coalesce(*[F.when(F.col("language") == x, i) for i, x in enumerate(order)], F.lit(len(order)))
    return files.filter("language is not null").groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), rank, "language").limit(1)


# Manifests at the root and the language each stands for, in the order in which they are looked for; ends of game projects' files.
MANIFESTS = (("requirements.txt", "python"), ("pyproject.toml", "python"), ("setup.py", "python"), ("*.py", "python"), ("package.json", "javascript"), ("go.mod", "go"), ("pubspec.yaml", "dart"), ("Cargo.toml", "rust"), ("*.uproject", "verse"), ("*.uplugin", "verse"), ("*.verse", "verse"))


def project_language(files: DataFrame) -> DataFrame:
    """One row (language): that of the first manifest in the root (JavaScript with tsconfig.json is TypeScript), else the dominant one; files: (path, language)."""
    path = F.col("path")
    fits = lambda m: (~path.contains("/") & path.endswith(m[1:])) if m.startswith("*") else path == m
    rank = F.coalesce(*[F.when(fits(m), F.struct(F.lit(i).alias("i"), F.lit(x).alias("language"))) for i, (m, x) in enumerate(MANIFESTS)])
    found = files.agg(F.min(rank).alias("m"), F.max((path == "tsconfig.json").cast("int")).alias("ts"))
    # One row each.
    both = found.join(dominant_language(files).select(F.col("language").alias("most")), F.lit(True), "left")
    by_manifest = F.when((F.col("m.language") == "javascript") & (F.col("ts") == 1), "typescript").otherwise(F.col("m.language"))
    return both.select(F.coalesce(by_manifest, "most").alias("language")).filter("language is not null")


def rows_of(files: DataFrame, parse: Callable[[str, str], Iterable[tuple]], schema: str, columns: tuple[str, str] = ("path", "text")) -> DataFrame:
    """Rows that a parser yields for each (path, text), in Arrow batches.  A null text has none."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [r for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t is not None for r in parse(p, t)]
            cols = list(zip(*got, strict=True)) if got else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return files.select(*columns).mapInArrow(run, schema)


def env_keys(files: DataFrame) -> DataFrame:
    """(path, key) of `.env` files: names before `=`, without comments and `export`."""
    ln = files.select("path", F.explode(F.split("text", "\n")).alias("l"))
    key = F.regexp_extract("l", r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=", 1)
    return ln.select("path", key.alias("key")).filter("key <> ''").distinct()


# How environment variables are read, and variables of any shell.
ENV_READS = (
    r"process\.env\.([A-Z][A-Z0-9_]+)",
    r"""process\.env\[["']([A-Z][A-Z0-9_]+)["']\]""",
    r"import\.meta\.env\.([A-Z][A-Z0-9_]+)",
    r"""Deno\.env\.get\(["']([A-Z][A-Z0-9_]+)["']\)""",
    r"""os\.environ\[["']([A-Z][A-Z0-9_]+)["']\]""",
    r"""os\.environ\.get\(\s*["']([A-Z][A-Z0-9_]+)["']""",
    r"""os\.getenv\(\s*["']([A-Z][A-Z0-9_]+)["']""",
    r'env::var(?:_os)?\(\s*"([A-Z][A-Z0-9_]+)"',
    r'(?:option_)?env!\(\s*"([A-Z][A-Z0-9_]+)"',
    r'os\.(?:Getenv|LookupEnv)\(\s*"([A-Z][A-Z0-9_]+)"',
    r"""Platform\.environment\[["']([A-Z][A-Z0-9_]+)["']\]""",
    r"""fromEnvironment\(\s*["']([A-Z][A-Z0-9_]+)["']""",
    r'System\.getenv\(\s*"([A-Z][A-Z0-9_]+)"',
    r"""ENV(?:\.fetch\(|\[)\s*["']([A-Z][A-Z0-9_]+)["']""",
)
AMBIENT = ("PATH", "HOME", "TERM", "USER", "SHELL", "LANG", "LC_ALL", "PWD", "TMPDIR", "TEMP", "TMP", "HOSTNAME", "EDITOR", "XDG_CONFIG_HOME")


def env_reads(files: DataFrame) -> DataFrame:
    """(key, path, line) of the first place that reads each variable; variables of any shell are left out."""
    ln = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    found = F.flatten(F.array(*[F.regexp_extract_all("l", F.lit(p), F.lit(1)) for p in ENV_READS]))
    hit = ln.select("path", (F.col("line") + 1).alias("line"), F.explode(F.array_distinct(found)).alias("key")).filter(~F.col("key").isin(*AMBIENT))
    return hit.groupBy("key").agg(F.min(F.struct("path", "line")).alias("m")).select("key", "m.path", "m.line")


def package_names(files: DataFrame) -> DataFrame:
    """(path, package) from manifests."""
    name = F.col("path")
    toml = F.regexp_extract("text", r"(?m)^\s*name\s*=\s*\"([^\"]+)\"", 1)
    pkg = (
        F.when(name.rlike(r"(^|/)package\.json$"), F.get_json_object("text", "$.name"))
        .when(name.rlike(r"(^|/)(pyproject|Cargo)\.toml$"), toml)
        .when(name.rlike(r"(^|/)setup\.py$"), F.regexp_extract("text", r"name\s*=\s*[\"']([^\"']+)", 1))
        .when(name.rlike(r"(^|/)go\.mod$"), F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1))
    )
    return files.select("path", pkg.alias("package")).filter("package is not null and package <> ''")


def space(spark: SparkSession, root: str, kinds: tuple[str, ...] = SKIP_DIRS, least: int = 500 * 1024) -> DataFrame:
    """(folder, kind, bytes, files) of heavy folders over a size, largest first; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(relative(F.col("path"), root).alias("path"), "length")
    alt = "|".join(k.replace(".", r"\.") for k in kinds)
    hit = f.withColumn("folder", F.regexp_extract("path", rf"^((?:[^/]+/)*?({alt}))/", 1)).filter("folder <> ''")
    g = hit.groupBy("folder").agg(F.sum("length").alias("bytes"), F.count("*").alias("files")).filter(F.col("bytes") > least)
    return g.select("folder", F.element_at(F.split("folder", "/"), -1).alias("kind"), "bytes", "files").orderBy(F.desc("bytes"), "folder")


def human_size(n: Column) -> Column:
    n = n.cast("double")
    return F.when(n >= 1 << 30, F.concat(F.format_number(n / (1 << 30), 1), F.lit(" GB"))).when(n >= 1 << 20, F.concat(F.format_number(n / (1 << 20), 1), F.lit(" MB"))).when(n >= 1 << 10, F.concat(F.format_number(n / (1 << 10), 1), F.lit(" KB"))).otherwise(F.concat(n.cast("long").cast("string"), F.lit(" B")))
