"""Sources: file trees, archives' manifests, commit logs, guards."""

from __future__ import annotations

import os
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_code, is_test_path, language, line_count, redact
from ..operators.tables import last_known
from ..shared import stored

# Our own choice of what is not read: dependency, build and tool folders, locks, bundles.
IGNORED_FOLDERS = "node_modules vendor dist build out target coverage __pycache__ venv .git .hg .svn .venv .next .nuxt .cache .idea .vscode bower_components".split()
IGNORED_FILES = (r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Cargo\.lock|composer\.lock|Gemfile\.lock|go\.sum)$", r"\.min\.(js|css)$", r"\.(map|lock|png|jpe?g|gif|ico|pdf|zip|gz|jar|woff2?|ttf|mp[34]|exe|dll|so|class|pyc)$")
#: A generated file says so in its first lines: in so many characters. What stands further down is quoted or talked about.
GENERATED_HEAD = 600
GENERATED = r"(?i)(@generated|code generated .* do not edit|auto-?generated|do not edit)"
MAX_FILE, MAX_FILES, MAX_BYTES, SCOPE_LIMIT = 400 * 1024, 25_000, 500 * 1024 * 1024, 4_000
MAX_ENTRIES, BOMB_BYTES, BOMB_RATIO = 25_000, 50_000_000, 10


def scan_tree(spark: SparkSession, *roots: str) -> DataFrame:
    """root, path (relative, /), bytes, data of every file under the roots (one a repository), hidden ones too.

    Spark's file readers leave out names that begin with a dot, and those are often wanted here (.github, .env.example).
    So folders are listed level by level, each by the task it is dealt to, and files are read where they land, at most `MAX_FILE` bytes each;
    larger and empty files have null data and their size. Symbolic links are skipped.
    """

    def listed(batches):
        for batch in batches:
            for root, folder in zip(batch["root"].to_pylist(), batch["folder"].to_pylist(), strict=True):
                store, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")
                at = f"{base.rstrip('/')}/{folder}".rstrip("/")
                found = [f for f in store.get_file_info(fs.FileSelector(at)) if not (store.type_name == "local" and os.path.islink(f.path))]
                for i in range(0, len(found), 5000):
                    some = found[i : i + 5000]
                    yield pa.RecordBatch.from_pydict({"root": [root] * len(some), "full": [f.path for f in some], "path": [f.path[len(base.rstrip("/")) + 1 :] for f in some], "bytes": [f.size for f in some], "folder": [f.type == fs.FileType.Directory for f in some]}, schema=_LISTED)

    def opened(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = None
                if 0 < row["bytes"] <= MAX_FILE:
                    store, _ = fs.FileSystem.from_uri(row["root"] if "://" in row["root"] else f"file://{os.path.abspath(row['root'])}")
                    with store.open_input_stream(row["full"]) as f:
                        data = f.read()
                yield pa.RecordBatch.from_pydict({"root": [row["root"]], "path": [row["path"]], "bytes": [row["bytes"]], "data": [data]}, schema=_READ)

    open_, names = spark.createDataFrame([(r, "") for r in roots], "root string, folder string"), None
    while True:  # as many rounds as folders are deep
        level = stored(open_.repartition("root", "folder").mapInArrow(listed, "root string, full string, path string, bytes long, folder boolean"), "listed")
        files = level.where(~F.col("folder")).drop("folder")
        names = files if names is None else names.unionByName(files)
        open_ = level.where("folder").select("root", F.col("path").alias("folder"))
        if open_.isEmpty():
            break
    return names.repartition("root", "path").mapInArrow(opened, "root string, path string, bytes long, data binary")


def write_tree(files: DataFrame, root: str) -> None:
    """Write each row (path, data) as a file under a root that all executors share; a row that is written again replaces its file."""

    def put(batches):
        for batch in batches:
            store, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")
            made = set()
            for path, data in zip(batch["path"].to_pylist(), batch["data"].to_pylist(), strict=True):
                folder = os.path.dirname(f"{base}/{path}")
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{base}/{path}") as out:
                    out.write(data or b"")
            yield pa.RecordBatch.from_pydict({"n": [len(batch)]})

    files.select("path", "data").mapInArrow(put, "n long").agg(F.sum("n")).collect()  # one row


_LISTED = pa.schema([("root", pa.string()), ("full", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("folder", pa.bool_())])
_READ = pa.schema([("root", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("data", pa.binary())])


def not_ignored(path: Column, patterns: list[str] | None = None) -> Column:
    """Our ignore rules, and any further patterns (for example of an ignore file, by `ignore_pattern`)."""
    folders = "(^|/)(" + "|".join(f.replace(".", r"\.") for f in IGNORED_FOLDERS) + ")/"
    return reduce(lambda a, p: a & ~path.rlike(p), [*IGNORED_FILES, *(patterns or [])], ~path.rlike(folders))


def ignore_pattern(line: str) -> str | None:
    """One line of an ignore file as a pattern over relative paths; comments, blanks and negations give none."""
    import re

    rule = line.strip()
    if not rule or rule[0] in "#!":
        return None
    body = "".join(".*" if p == "**" else "[^/]*" if p == "*" else "[^/]" if p == "?" else re.escape(p) for p in re.findall(r"\*\*|\*|\?|[^*?]+", rule.strip("/")))
    return ("^" if "/" in rule.rstrip("/") else "(^|/)") + body + ("/" if rule.endswith("/") else "(/|$)")


def in_scope(path: Column, modules: list[str]) -> Column:
    """path is a module or under one; no modules, everything."""
    return reduce(lambda a, m: a | (path == m) | path.startswith(m + "/"), modules, F.lit(False)) if modules else F.lit(True)


def size_ok(size: Column, most: int = MAX_FILE) -> Column:
    return size.between(1, most)


def running(df: DataFrame, value: str, order: list[str], name: str, within: list[str] | None = None) -> DataFrame:
    """Add the running sum of a column in order."""
    w = Window.partitionBy(*(within or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(w))


def collect_files(tree: DataFrame, modules: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """path, lang, loc, bytes, is_test, sha, content, findings, stored_loc, stored_sha: the files worth reading, redacted.

    One narrow plan, cheap tests first: ignore rules, scope, size, binary (a zero byte in the first 8 KB), generated marks (in the first `GENERATED_HEAD` characters), then redaction.
    loc and sha are of the redacted content; stored_loc and stored_sha, like bytes, of the file as it lies in the tree, so that they differ where something was redacted.
    """
    kept = tree.where(not_ignored(F.col("path"), ignore) & in_scope(F.col("path"), modules or []) & size_ok(F.col("bytes")))
    text = kept.where(~F.substring("data", 1, 8192).cast("string").contains("\x00")).withColumn("content", F.col("data").cast("string"))
    text = text.where(~F.left("content", F.lit(GENERATED_HEAD)).rlike(GENERATED)).withColumn("stored_sha", F.sha2("data", 256)).drop("data")
    text = text.withColumns({"lang": language(F.col("path")), "is_test": is_test_path(F.col("path"))})
    loc = F.when(is_code(F.col("lang")), line_count(F.col("content"))).otherwise(0)
    out = redact(text.withColumn("stored_loc", loc), "content")
    return out.select("path", "lang", loc.alias("loc"), "bytes", "is_test", F.sha2("content", 256).alias("sha"), "content", "findings", "stored_loc", "stored_sha")


def worth_summarising(path: Column, lang: Column, content: Column) -> Column:
    return (F.length(F.trim(content)) >= 200) & ((lang != "JSON") | path.rlike(r"(^|/)(package|composer|tsconfig)[^/]*\.json$"))


def url_allowed(url: Column, hosts: list[str]) -> Column:
    """http(s), no credentials, no private address, host on the list or under it."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/:?#@]+)(?:[:/?#]|$)", 1))
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2[0-9]|3[01])\.)")
    listed = reduce(lambda a, h: a | (host == h) | host.endswith("." + h), hosts, F.lit(False))
    return (host != "") & ~private & listed


def zip_entry_ok(path: Column, mode: Column | None = None) -> Column:
    """Relative, no .., no NUL; not a symlink where the mode is known."""
    ok = ~path.startswith("/") & ~path.rlike(r"^[A-Za-z]:") & ~F.array_contains(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), "..") & ~path.contains("\x00")
    return ok if mode is None else ok & (mode.bitwiseAND(F.lit(0o170000)) != F.lit(0o120000))


def zip_bomb(packed: Column, expanded: Column) -> Column:
    """Sizes of any integer type; an empty or unknown packed size says nothing."""
    return (packed > 0) & (expanded > BOMB_BYTES) & (expanded / BOMB_RATIO > packed)


def archive_refusals(entries: DataFrame, by: list[str], most_entries: int = MAX_ENTRIES, most_bytes: int = MAX_BYTES) -> DataFrame:
    """by, entries, refused: what the first bad entry of each archive breaks (entries, path, symlink, bytes or bomb), or null.

    entries has n (a number from 1), path, mode, expanded, and packed, the size of the whole archive. Folders (with a / at the
    end) expand to nothing; unknown modes and sizes break no bound.
    """
    size = F.when(F.col("path").endswith("/"), 0).otherwise(F.col("expanded"))
    seen = running(entries.withColumn("__size", size), "__size", ["n"], "__sum", by)
    path = F.col("path")
    why = F.when(F.col("n") > most_entries, "entries").when(~zip_entry_ok(path), "path").when(~zip_entry_ok(path, F.col("mode")), "symlink")
    why = why.when(F.col("__sum") > most_bytes, "bytes").when(zip_bomb(F.col("packed"), F.col("__sum")), "bomb")
    first = F.min(F.when(why.isNotNull(), F.struct("n", why.alias("why"))))
    return seen.groupBy(*by).agg(F.count("*").alias("entries"), first["why"].alias("refused"))


def unwrap_root(files: DataFrame) -> DataFrame:
    """Without the single top folder, if every path has the same one."""
    top = files.agg(F.count_distinct(F.split_part("path", F.lit("/"), F.lit(1))).alias("n"), F.coalesce(F.bool_and(F.col("path").contains("/")), F.lit(False)).alias("deep"))
    inner = F.when((F.col("n") == 1) & F.col("deep"), F.regexp_replace("path", "^[^/]+/", "")).otherwise(F.col("path"))
    return files.join(F.broadcast(top), how="cross").withColumn("path", inner).drop("n", "deep")  # top is one row


def commit_log(lines: DataFrame) -> DataFrame:
    """commit, author, at, path of numbered log lines (n, line): headers are NUL-separated, file lines follow theirs. A log of any length is many ranges of lines."""
    head = F.when(F.col("line").contains("\x00"), F.split("line", "\x00"))
    named = last_known(lines, head, ["log"], ["n"], "head").where(F.col("line") != "")
    path = F.when(~F.col("line").contains("\x00"), F.col("line"))
    return named.select("log", F.col("head")[0].alias("commit"), F.col("head")[1].alias("author"), F.to_timestamp(F.col("head")[2]).alias("at"), path.alias("path"))


def limits(files: DataFrame, by: list[str], most_files: int = MAX_FILES, most_bytes: int = MAX_BYTES) -> DataFrame:
    """by, files, bytes, over: which bound a repository passes first, by its totals (bytes of all files, whatever is kept), or null."""
    over = F.when(F.col("bytes") > most_bytes, "bytes").when(F.col("files") > most_files, "files")
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).withColumn("over", over)


def within_limits(files: DataFrame, by: list[str], most_files: int = MAX_FILES, most_bytes: int = MAX_BYTES) -> DataFrame:
    """files; the job fails, and names the repository, where one is over its bounds. Totals are one row a repository, joined back; null is a name too."""
    name = F.concat_ws("/", *by)
    said = limits(files, by, most_files, most_bytes).withColumn("__fits", F.when(F.col("over").isNull(), True).otherwise(F.raise_error(F.concat(name, F.lit(" has too many "), F.col("over")))))
    told = said.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], "__fits")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)])
    return files.join(told, same).where("__fits").select(*files.columns)


def scope_alert(files: DataFrame, by: list[str], modules: list[str] | None = None, most: int = SCOPE_LIMIT) -> DataFrame:
    """by, files, modules: repositories with more files than `most`, for which no modules were chosen, and the top folders to choose from."""
    if modules:
        return files.groupBy(*by).agg(F.count("*").alias("files"), F.array_sort(F.collect_set("path")).alias("modules")).where("false")
    folder = F.when(F.col("path").contains("/"), F.split_part("path", F.lit("/"), F.lit(1)))
    counted = files.groupBy(*by, folder.alias("__folder")).agg(F.count("*").alias("__n"))  # few folders a repository meet in its row
    return counted.groupBy(*by).agg(F.sum("__n").alias("files"), F.array_sort(F.collect_set("__folder")).alias("modules")).where(F.col("files") > most)
