import datetime as dt
import os

from pyspark.sql import functions as F

from palimpsest import sources
from palimpsest.functions.text import is_test_path, language, line_count
from palimpsest.operators import chunks, evidence, facts, ledger, reports, schedule, tables
from palimpsest.plans import fan_out

PACKAGE = '{"name": "x", "description": "A shop", "main": "./src/main.js", "scripts": {"start": "node src/index.js"}, "dependencies": {"express": "^4", "pg": "8"}, "devDependencies": {"jest": "29"}}'
ROUTES = "const r = 1;\nrouter.get('/tasks', list)\nrouter.post(\n  '/tasks', add)\nrouter.all('/any', x)\nrouter.get('/tasks', again)\n"
DDL = "CREATE TABLE IF NOT EXISTS tasks (\n  id SERIAL PRIMARY KEY,\n  title TEXT,\n  done BOOLEAN,\n  PRIMARY KEY (id)\n);\n"
FILES = {
    "package.json": PACKAGE, "src/index.js": "const port = process.env.PORT || process.env['DATABASE_URL'];\napp.get('/health', h)\n", "src/routes/tasks.js": ROUTES, "migrations/001.sql": DDL,
    "requirements.txt": "# none\nflask>=2.0\nnumpy\n", "go.mod": "module x\n\trequire (\n\tgithub.com/a/b v1.2.3\n)", "Cargo.toml": 'serde = "1.0"\ntokio = { version = "1.2" }\n', "pom.xml": "<artifactId>core</artifactId>\n<version>2</version>",
    "Gemfile": 'gem "rails", "7"\n', "app/api/users/[id]/route.ts": "x", "models.py": "class Thing(models.Model):\n    name = models.CharField()\n    n = models.IntegerField()\nclass Other(models.Model):\n    z = models.X()\n",
    "schema.prisma": "model User {\n  id Int\n  name String\n}\n", ".github/workflows/ci.yml": "x", "docker-compose.yml": "x", "Dockerfile": "x", ".env.example": "API_URL=1\n", "tests/a.test.js": "app.get('/no', x)\n", "infra/main.tf": "x",
}


def file_table(spark):
    df = spark.createDataFrame(list(FILES.items()), "path string, content string")
    return df.withColumns({"lang": language(F.col("path")), "is_test": is_test_path(F.col("path")), "loc": line_count(F.col("content")).cast("long")})


def test_facts(spark):
    r = facts.all_facts(file_table(spark)).first()
    assert {(d.ecosystem, d.name, d.version, d.dev) for d in r.dependencies} >= {("npm", "express", "^4", False), ("npm", "jest", "29", True), ("pypi", "flask", "2.0", False), ("pypi", "numpy", "*", False), ("go", "github.com/a/b", "v1.2.3", False), ("cargo", "tokio", "1.2", False), ("maven", "core", "2", False), ("gem", "rails", "7", False)}
    assert {"Express", "Flask", "Jest", "NumPy", "Rails", "Tokio"} <= set(r.frameworks)
    assert {(x.method, x.path, x.file, x.line) for x in r.routes} == {("GET", "/health", "src/index.js", 2), ("GET", "/tasks", "src/routes/tasks.js", 2), ("POST", "/tasks", "src/routes/tasks.js", 3), ("ANY", "/any", "src/routes/tasks.js", 5), ("ANY", "/api/users/:id", "app/api/users/[id]/route.ts", 1)}
    tables_ = {t.name: t["columns"] for t in r.tables}
    assert tables_ == {"tasks": ["id", "title", "done"], "User": ["id", "name"], "thing": ["name", "n"], "other": ["z"]}
    assert r.env == ["API_URL", "DATABASE_URL", "PORT"] and r.ci == ["GitHub Actions"] and r.iac == ["Terraform"] and r.has_dockerfile and r.has_compose
    assert r.entrypoints == ["src/index.js", "src/main.js"] and r.description == "A shop" and r.test_files == 1


def chunk_of(spark, path, lang, content):
    return chunks.chunk(spark.createDataFrame([(path, lang, content)], "path string, lang string, content string")).orderBy("start_line").collect()


def test_chunks(spark):
    body = "\n".join(f"    x{i} = {i} * 2  # a line that is long enough" for i in range(20))
    code = "import os\n\n" + "\n".join(f"def f{i}():\n{body}\n" for i in range(6))
    got = chunk_of(spark, "a.py", "Python", code)
    assert got[0].symbol == "(imports), f0, f1" and [c.start_line for c in got[1:]] == [c.end_line + 1 for c in got[:-1]]
    assert "\n".join(c.content for c in got) == code[: sum(len(c.content) + 1 for c in got) - 1]
    long = "def big():\n" + "\n".join(("    y = 1  # padding padding padding" if i % 10 else "") for i in range(300))
    parts = chunk_of(spark, "b.py", "Python", long)
    assert len(parts) > 3 and all(p.symbol == "big" and len(p.content) < 2000 for p in parts)
    plain = "\n".join(["a line of text that goes on"] * 60 + [""] + ["another line of text"] * 60)
    assert [(c.symbol, c.start_line, c.end_line) for c in chunk_of(spark, "c", "Other", plain)] == [(None, 1, 61), (None, 62, 121)]
    assert chunk_of(spark, "d.py", "Python", "def f():\n    pass\n") == []  # short and ends in white space
    assert len(chunk_of(spark, "d.py", "Python", "def f():\n    pass")) == 1


def test_chunks_are_disjoint(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.lit("Other").alias("lang"), F.col("text").alias("content"))
    rows = chunks.chunk(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path, []).append((r.start_line, r.end_line))
    for spans in by.values():
        spans.sort()
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_collect(spark, tmp_path):
    for path, content in {**FILES, "node_modules/x/i.js": "x", "a.min.js": "x", "gen.py": "# @generated\nx = 1", "secret.py": 'DB_PASSWORD = "hunter2hunter2"\n'}.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(content)
    (tmp_path / "bin.dat").write_bytes(b"\x00\x01")
    (tmp_path / "empty.py").write_text("")
    got = {r.path: r for r in sources.collect_files(sources.scan_tree(spark, str(tmp_path))).collect()}
    assert set(got) == set(FILES) | {"secret.py"}
    assert [f.rule for f in got["secret.py"].findings] == ["generic_assignment"] and got["src/index.js"].loc == 3 and got["package.json"].loc == 0
    scoped = sources.collect_files(sources.scan_tree(spark, str(tmp_path)), ["src"], [p for p in map(sources.ignore_pattern, ["# x", "routes/", "*.md"]) if p])
    assert {r.path for r in scoped.select("path").collect()} == {"src/index.js"}


def test_guards(spark):
    urls = {"https://github.com/a/b": True, "https://x@github.com/a": False, "http://127.0.0.1/a": False, "ssh://github.com/a": False, "https://api.github.com/a": True, "https://evilgithub.com": False}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", sources.url_allowed(F.col("u"), ["github.com"]).alias("ok"))
    assert {r.u: r.ok for r in df.collect()} == urls
    paths = {"a/b": True, "/a": False, "a/../b": False, "a..b/c": True, "C:\\x": False, "a\x00b": False}
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", sources.zip_entry_ok(F.col("p")).alias("ok"))
    assert {r.p: r.ok for r in df.collect()} == paths
    log = spark.createDataFrame([("l", 0, "c1\x00Ann\x002026-01-01T00:00:00Z"), ("l", 1, "a.py"), ("l", 2, "b.py"), ("l", 3, ""), ("l", 4, "c2\x00Bo\x002026-01-02T00:00:00Z"), ("l", 5, "a.py")], "log string, n int, line string")
    assert [(r.path, r.changes) for r in facts.churn(sources.commit_log(log)).collect()] == [("a.py", 2), ("b.py", 1)]


def test_citations(spark):
    c = spark.createDataFrame([(1, "s", "a", 5, 25), (2, "s", "a", 31, 40), (3, "s", "b", 1, 1)], "citation_id int, snapshot string, path string, start_line int, end_line int")
    k = spark.createDataFrame([("s", "a", 11, 20, "two"), ("s", "a", 1, 10, "one"), ("s", "a", 21, 30, "three")], "snapshot string, path string, start_line int, end_line int, content string")
    assert [tuple(r) for r in evidence.resolve(c, k).collect()] == [(1, 1, 30, "one\ntwo\nthree")]


def test_greedy_dedupe_is_order_dependent(spark):
    # a ~ b, b ~ c, a !~ c: b goes because of a, so c stays.
    v = {1: [1.0, 0.0], 2: [0.8, 0.6], 3: [0.28, 0.96]}
    df = spark.createDataFrame([(i, x) for i, x in v.items()], "id int, v array<double>")
    assert [r.id for r in evidence.greedy_dedupe(df, "id", "v", ["id"], 0.7).orderBy("id").collect()] == [1, 3]
    grouped = df.withColumn("g", F.col("id") % 2)
    assert evidence.greedy_dedupe(grouped, "id", "v", ["id"], 0.7, ["g"]).count() == 3


def test_schedule(spark):
    at = dt.datetime(2026, 1, 1)
    rows = [(1, at, 3), (1, at + dt.timedelta(days=3), 3), (2, at, 4), (2, at + dt.timedelta(days=20), 1), (3, at, 1)]
    got = {r.card: r for r in schedule.replay(spark.createDataFrame(rows, "card int, at timestamp, rating int"), "card", "at", "rating").collect()}
    r = (1 + 19 / 81 * 3 / 3.2) ** -0.5
    assert abs(got[1].stability - 3.2 * (1 + 1.6 * (1 - r) * (11 - 5.4) / 10)) < 1e-9 and got[1].reps == 2
    assert abs(got[2].stability - 15.7 * 0.35) < 1e-9 and got[2].lapses == 1 and got[3].stability == 0.4 and got[3].interval_days == 0.4


def test_ledger(spark):
    u = spark.createDataFrame([(1, "balanced", 10_000, 1000, 5000), (2, "hosted", 10, 10, 0), (3, "local", 9, 9, 0)], "id int, tier string, tokens_in long, tokens_out long, cached long")
    assert {r.id: r.cents for r in ledger.priced(u).collect()} == {1: 3.15, 2: None, 3: 0.0}


def test_tables(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in tables.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in tables.insert_ignore(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}
    made = []
    for _ in range(2):
        out = tables.checkpointed(spark, f"file://{tmp_path}", "stage", "inputs-1", lambda: made.append(1) or old)
    assert len(made) == 1 and out.count() == 2


def test_plan_and_reports(spark, tmp_path):
    plan = fan_out(spark).orderBy("seq").collect()
    assert len(plan) == 38 and sum(r["count"] for r in plan) == 95 and [r.persona for r in plan[:3]] == ["hiring-manager", "tech-lead", "peer"]
    assert sum(r["count"] for r in fan_out(spark, trivial=True).collect()) == 81
    items = spark.createDataFrame([("security", 1, "S1", "A"), ("testing", 2, "T", "B"), ("security", 3, "S2", "C")], "category string, n int, stem string, answer string")
    lines = reports.markdown_lines(items, "category", ["n"], "stem", "answer")
    reports.write_lines(lines, "line", ["category_no", "item_no"], f"file://{tmp_path}/md")
    text = "".join(open(f"{tmp_path}/md/{f}").read() for f in sorted(os.listdir(f"{tmp_path}/md")) if f.startswith("part"))
    assert [x for x in text.split("\n") if x.startswith("#")] == ["## Security", "### 1. S1", "### 2. S2", "## Testing", "### 1. T"]


def test_batches_number_ranges(spark):
    rows = [(i * 7919 % 1000, "x") for i in range(1000)]
    got = tables.batches(spark.createDataFrame(rows, "k long, other string").repartition(6), 96, ["k"])
    assert got.columns == ["k", "other", "batch"]
    assert sorted((r.k, r.batch) for r in got.collect()) == [(i, i // 96) for i in range(1000)]
    assert tables.batches(spark.createDataFrame([], "k long"), 96, ["k"]).count() == 0


def test_archive_refusals(spark):
    """The first bad entry decides; folders expand to nothing; unknown modes and an unknown packed size break no bound; sizes may be 32-bit."""
    rows = [
        ("sound", 1, "a/", None, 900, 10), ("sound", 2, "a/b", None, 100, None), ("twice", 1, "/a", 0o120777, 1, 1), ("twice", 2, "b", 0o120777, 1, 1), ("link", 1, "a", 0o120777, 1, 1),
        ("large", 1, "a", 0o100644, 60, 50), ("large", 2, "b", 0o100644, 60, 50), ("many", 1, "a", None, 1, 1), ("many", 3, "b", None, 1, 1),
        ("bomb", 1, "a", None, 60_000_000, 1000), ("tight", 1, "a", None, 60_000_000, 2_000_000_000), ("empty", 1, "a", None, 60_000_000, 0),
    ]
    df = spark.createDataFrame(rows, "archive string, n int, path string, mode int, expanded int, packed int")
    small = {r["archive"]: r["refused"] for r in sources.archive_refusals(df.where("expanded < 1000"), ["archive"], 2, 100).collect()}
    assert small == {"sound": None, "twice": "path", "link": "symlink", "large": "bytes", "many": "entries"}
    large = {r["archive"]: r["refused"] for r in sources.archive_refusals(df.where("expanded > 1000"), ["archive"]).collect()}
    assert large == {"bomb": "bomb", "tight": None, "empty": None}
    assert sources.archive_refusals(df.where("false"), ["archive"]).count() == 0
