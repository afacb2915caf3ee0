"""Rules about source text, and the values that they rest on."""

import pytest
from pyspark.sql import functions as F

from loamline.operators import code_audit as K
from loamline.operators import retrieval as R
from loamline.sources import files as FS

SENSITIVE = """.env .env.local .env.production .env.staging .env.development .env.test credentials.json service-account.json secrets.yaml secrets.yml secrets.json
secrets.toml .npmrc .pypirc .netrc .htpasswd id_rsa id_ed25519 id_ecdsa id_dsa known_hosts authorized_keys .pgpass token.json""".split()
EXTENSIONS = "pem key p12 pfx jks keystore crt cer der p7b".split()


def test_sensitive_names(spark):
    names = [*SENSITIVE, *(f"deep/in/{x}" for x in SENSITIVE), *(f"a/server.{x}" for x in EXTENSIONS)]
    fine = ["main.py", "package.json", ".env.example", "token.json.md", "my-id_rsa", ".pem", "pem", "a.pem.txt", "keys/readme.md"]
    df = spark.createDataFrame([(x,) for x in names + fine], "path string")
    got = {r.path for r in df.filter(FS.is_sensitive(F.col("path"))).collect()}
    assert got == set(names)
    assert list(FS.SENSITIVE_FILENAMES) == SENSITIVE and list(FS.SENSITIVE_EXTENSIONS) == EXTENSIONS


READS = [
    "process.env.AB", "process.env['AB']", "import.meta.env.AB", "Deno.env.get('AB')", "os.environ['AB']", "os.environ.get( 'AB'", "os.getenv('AB'", 'env::var("AB"', 'env::var_os("AB"', 'env!("AB"', 'option_env!( "AB"',
    'os.Getenv("AB"', 'os.LookupEnv("AB"', "Platform.environment['AB']", "String.fromEnvironment('AB'", 'System.getenv("AB"', "ENV['AB']", "ENV.fetch('AB']",
]
AMBIENT = "PATH HOME TERM USER SHELL LANG LC_ALL PWD TMPDIR TEMP TMP HOSTNAME EDITOR XDG_CONFIG_HOME".split()


def test_environment_reads(spark):
    rows = [(f"f{k:02}", x.replace("AB", f"KEY_{k}")) for k, x in enumerate(READS)] + [("g", "process.env.A"), ("h", "\n".join(f"process.env.{x}" for x in AMBIENT)), ("i", "process.env.CI\nprocess.env.KEY_0")]
    got = {(r.key, r.path, r.line) for r in FS.env_reads(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {(f"KEY_{k}", f"f{k:02}", 1) for k in range(len(READS))} | {("CI", "i", 1)}
    assert list(FS.AMBIENT) == AMBIENT


def test_symbols(spark):
    text = "pub fn load(x)\n  void paint(c)\nloop(X) -> ok\nresources \"/u\", plug :auth\n  User? currentUser()\n  factory User.guest()\nfinal authProvider = StateNotifierProvider<A, B>"
    df = spark.createDataFrame([(text,), ("fn a(x)",)], "text string").select(R.symbols(F.col("text"), most=20).alias("s"))
    assert [r.s for r in df.collect()] == [["load", "paint", "loop", "auth", "currentUser", "guest", "authProvider"], []]


def test_index_files(spark, tmp_path):
    keep = ["a.rs", "src/B.PY", "Dockerfile", "x/y/z/u/v.md", "lib/q.verse", "Plugins/p.cpp"]
    skip = ["a.txt", ".hidden/a.py", "node_modules/a.js", "Saved/a.cpp", "x/y/z/u/v/w/t.md", "a.pb.go", "m_pb2.py", "n.gen.go", "coverage.xml", "secrets.json", "DerivedDataCache/a.c", "big.py", "skipme/a.py", "id_rsa"]
    for x in keep + skip:
        (tmp_path / x).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / x).write_text("x" * (500_001 if x == "big.py" else 3))
    got = FS.indexable(spark, str(tmp_path), ["skipme/"])
    assert {r.path for r in got.collect()} == set(keep) and len(FS.INDEX_EXTENSIONS) == 30


@pytest.mark.parametrize(
    "paths, want",
    [
        (["package.json", "src/a.py", "src/b.py"], "javascript"),
        (["package.json", "tsconfig.json"], "typescript"),
        (["go.mod", "setup.py"], "python"),
        (["main.py", "Cargo.toml"], "python"),
        (["src/x.py", "Cargo.toml"], "rust"),
        (["game.uproject"], "verse"),
        (["a/b.go", "a/c.go", "d.rs"], "go"),
        (["readme"], None),
    ],
)
def test_project_language(spark, paths, want):
    df = spark.createDataFrame([(x,) for x in paths], "path string").withColumn("language", FS.language(F.col("path")))
    assert [r.language for r in FS.project_language(df).collect()] == ([want] if want else [])


def test_terms_without_marks(spark):
    df = spark.createDataFrame([(1, "Crème brûlée"), (2, "creme"), (3, "Ångström øre"), (4, None)], "doc_id long, text string")
    assert {r.id for r in R.bm25(df, ["creme"], "doc_id", "text").collect()} == {1, 2}
    assert [r.t for r in df.filter("doc_id = 3").select(R.tokens(F.col("text")).alias("t")).collect()] == [["angstrom", "øre"]]


def found(spark, path, text, *families):
    df = spark.createDataFrame([(path, text)], "path string, text string")
    return [(r.line, r.rule, r.severity) for r in K.line_findings(df, families or tuple(K.FAMILIES)).orderBy("line").collect()]


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("api.py", "@app.get('/proxy')\ndef proxy():\n    url = args['target']\n    resp = requests.get(url)", [(4, "ssrf", "high")]),
        ("client.py", "resp = requests.get(url)", []),
        ("server.ts", "app.get('/proxy', async (q, r) => {\n  const x = await fetch(target)", [(2, "ssrf", "high")]),
        ("routes.py", '@app.get("/debug")', [(1, "debug-ep", "medium")]),
        ("routes.py", '@router.route("/debug/vars")', [(1, "debug-ep", "medium")]),
        ("routes.py", '@app.get("/users")', []),
        ("routes.py", '# @app.get("/debug")', []),
        ("main.go", 'app.get("/debug")', []),
        ("tests/test_routes.py", '@app.get("/debug")', [(1, "debug-ep", "low")]),
        ("a.py", "cfg = yaml.load(f)\ncfg = yaml.load(f, Loader=yaml.SafeLoader)\nyaml.safe_load(f)", [(1, "deser", "high")]),
        ("auth/token.py", "n = random.randint(1, 6)", [(1, "crypto", "high")]),
        ("dice.py", "n = random.randint(1, 6)", []),
        ("a.py", "c = DES.new(key)\niv = b'\\x00\\x00'", [(1, "crypto", "medium"), (2, "crypto", "medium")]),
        ("view.js", "e.innerHTML = user\ne.innerHTML = \"<b>\"\ne.outerHTML = m\nnew Function(code)", [(1, "xss", "high"), (3, "xss", "high"), (4, "xss", "high")]),
        ("chart.js", "import mermaid\ne.innerHTML = svg", [(2, "xss", "low")]),
        ("a.tsx", "<p dangerouslySetInnerHTML={{ __html: x }} />", [(1, "xss", "low")]),
        ("run.rs", 'Command::new(format!("{}", x))\nCommand::new("ls")', [(1, "cmdi", "critical")]),
        ("run.go", 'exec.Command(name + arg)\nexec.Command("ls")', [(1, "cmdi", "critical")]),
        ("a.ts", "fs.readFile(req.query.name)\nfs.readFile(path.join(base, req.query.name))", [(1, "pathtr", "high")]),
        ("none.txt", "eval(x)", []),
        ("null.py", None, []),
    ],
)
def test_line_rules(spark, path, text, want):
    assert found(spark, path, text) == want


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("lib.rs", 'a.unwrap();\n#[cfg(test)]\nmod t {\n  fn x() {\n    b.unwrap();\n  }\n}\nc.expect("set");\nd.expect("");\n// e.unwrap()', [(1, "err-rust", "medium"), (8, "err-rust", "low"), (9, "err-rust", "medium")]),
        ("src/main.rs", "a.unwrap();", []),
        ("a.py", "try:\n  x()\nexcept:\n  pass\nexcept Exception as e:\n  pass\nexcept Exception:\n  log()\nexcept BaseException:\n  raise", [(3, "err-py-bare", "high"), (5, "err-py-pass", "medium"), (9, "err-py-base", "high")]),
        ("a.ts", "try { a() } catch (e) {}\ntry {\n} catch (e) {\n}\ncatch (e) {\n  log(e)\n}", [(1, "err-js-empty", "medium"), (3, "err-js-empty", "medium")]),
        ("a.go", "_ = os.Remove(p)\nv, _ := f(x)\n_ = string(b)\n_ = fmt.Sprintf(x)\n_ = x\n// _ = g()", [(1, "err-go-discard", "medium"), (2, "err-go-discard", "medium")]),
        ("a.dart", "} catch (e) {\n} on FormatException catch (e) {\non X catch (e) {", [(1, "err-dart-bare", "medium")]),
        ("noext", "except:", []),
    ],
)
def test_error_rules(path, text, want):
    assert [(line, rule, sev) for _, line, rule, _, sev in K.error_rows(path, text)] == want


def test_config_rules(spark):
    rows = [
        ("settings.py", "# DEBUG = True\nDEBUG = True"),
        ("web/app.py", "app.run(debug=True)"),
        ("cmd/api/entry.go", 'Listen("0.0.0.0:80")\n// 0.0.0.0'),
        ("Dockerfile", "FROM a:latest\nCOPY . .\nuser root"),
        ("b/Dockerfile", "FROM a:1\nCOPY . ."),
        ("b/.dockerignore", ".git"),
        ("package.json", '{"scripts": {"preinstall": "wget x", "start": "node app.js"}}'),
        (".env", "A=1"),
        ("c/.env", "A=1"),
        ("c/.env.example", "A="),
        ("c/.gitignore", "x\n .env* "),
        ("d/.env", "A=1"),
        ("d/.gitignore", "x"),
        ("empty.py", None),
    ]
    got = {(r.file, r.line, r.rule) for r in K.config_findings(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {
        ("settings.py", 2, "debug-django"), ("web/app.py", 1, "debug-flask"), ("cmd/api/entry.go", 1, "bind-all"), ("Dockerfile", 1, "docker-latest"), ("Dockerfile", 2, "docker-copy-all"), ("Dockerfile", 3, "docker-root"),
        ("b/Dockerfile", 0, "docker-no-user"), ("package.json", 0, "npm-preinstall"), ("package.json", 0, "node-env"), (".env", 0, "env-no-example"), (".env", 0, "no-gitignore"), ("d/.env", 0, "env-no-example"), ("d/.gitignore", 0, "env-not-gitignored"),
    }


def test_history_rules(spark):
    rows = [("c1", "remove old file", "password = 1"), ("c2", "refactor audit", "password"), ("c3", "scanner output", "token"), ("c4", "drop it", "nothing"), ("c5", "oops", "AKIA")]
    r = K.history_findings(spark.createDataFrame(rows, "commit string, subject string, text string")).first()
    assert (r.commits, r.n, r.severity) == (["c1 remove old file", "c5 oops"], 2, "high")
    assert K.history_findings(spark.createDataFrame(rows[3:4], "commit string, subject string, text string")).count() == 0
