"""Deterministic facts of a file table (path, lang, content, is_test): one DataFrame a kind of fact.

Each extractor is a narrow plan over its file plus, where the first mention wins, one ranking by key. Positions are
kept as (path, position), so "first" means the same at any partitioning.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import file_name, is_code, lookup, newlines


def _first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def census(files: DataFrame) -> DataFrame:
    """lang, files, loc, share of all lines of code; prose, configuration and unknown files don't count."""
    code = files.where(is_code(F.col("lang")) & (F.col("lang") != "Other")).groupBy("lang").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    return code.withColumn("share", F.round(F.col("loc") / F.greatest(F.sum("loc").over(Window.partitionBy()), F.lit(1)), 6))


def _matches(df: DataFrame, pattern: str, groups: list[int], names: list[str]) -> DataFrame:
    """One row per match, with the groups and the number of the match in its file. Groups that took no part are empty."""
    found = [F.regexp_extract_all("content", F.lit(pattern), F.lit(g)) for g in groups]
    zipped = F.arrays_zip(*[f.alias(n) for f, n in zip(found, names, strict=True)])
    out = df.where(F.col("content").rlike(pattern)).select("*", F.posexplode(zipped).alias("__i", "__m"))
    return out.select(*[c for c in out.columns if c != "__m"], *[F.col("__m")[n].alias(n) for n in names]).drop("__m")


#: Fixed values. (file pattern, order, ecosystem, pattern, group of the name, groups of the version)
_MANIFESTS = (
    (r"^requirements.*\.txt$|requirements.*\.txt$", 3, "pypi", r"(?m)^\s*(?!#)([A-Za-z0-9._-]+)\s*(?:[><=!~]+\s*([\w.*]+))?", 1, (2,)),
    (r"^pyproject\.toml$", 4, "pypi", r"(?m)^\s*([A-Za-z0-9._-]+)\s*=\s*[\"']([^\"']+)[\"']", 1, (2,)),
    (r"^pyproject\.toml$", 5, "pypi", r"[\"']([A-Za-z0-9._-]+)\s*[><=~^]+\s*([\w.]+)[\"']", 1, (2,)),
    (r"^go\.mod$", 6, "go", r"(?m)^\s*([\w./-]+)\s+(v[\w.+-]+)", 1, (2,)),
    (r"^Cargo\.toml$", 7, "cargo", r"(?m)^\s*([A-Za-z0-9_-]+)\s*=\s*(?:\"([^\"]+)\"|\{[^}]*version\s*=\s*\"([^\"]+)\")", 1, (2, 3)),
    (r"^pom\.xml$", 8, "maven", r"<artifactId>([^<]+)</artifactId>\s*(?:<version>([^<]+)</version>)?", 1, (2,)),
    (r"^build\.gradle", 9, "maven", r"[\"']([\w.-]+):([\w.-]+):([\w.\-+]+)[\"']", 2, (3,)),
    (r"^Gemfile$", 10, "gem", r"(?m)^\s*gem\s+[\"']([^\"']+)[\"'](?:\s*,\s*[\"']([^\"']+)[\"'])?", 1, (2,)),
)


def dependencies(files: DataFrame) -> DataFrame:
    """ecosystem, name, version (* if not said), dev: the first mention of ecosystem and name in path order."""
    named = files.select("path", "content", file_name(F.col("path")).alias("__base"))
    parts = []
    for base, key, ecosystem, dev, order in (("package.json", "dependencies", "npm", False, 1), ("package.json", "devDependencies", "npm", True, 2), ("composer.json", "require", "composer", False, 11)):
        rows = named.where(F.col("__base") == base).select("path", F.posexplode(F.map_entries(F.from_json(F.get_json_object("content", f"$.{key}"), "map<string,string>"))).alias("__i", "e"))
        parts.append(rows.select("path", F.lit(order).alias("__o"), "__i", F.lit(ecosystem).alias("ecosystem"), F.col("e.key").alias("name"), F.col("e.value").alias("version"), F.lit(dev).alias("dev")))
    for base, order, ecosystem, pattern, name, versions in _MANIFESTS:
        names = ["name", *(f"v{g}" for g in versions)]
        rows = _matches(named.where(F.col("__base").rlike(base)), pattern, [name, *versions], names)
        version = F.coalesce(*[F.nullif(F.col(v), F.lit("")) for v in names[1:]], F.lit("*"))
        parts.append(rows.select("path", F.lit(order).alias("__o"), "__i", F.lit(ecosystem).alias("ecosystem"), "name", version.alias("version"), F.lit(False).alias("dev")))
    every = reduce(DataFrame.unionByName, parts).where("name != ''")
    return _first(every, ["ecosystem", "name"], ["path", "__o", "__i"]).select("ecosystem", "name", F.coalesce(F.nullif("version", F.lit("")), F.lit("*")).alias("version"), "dev")


def frameworks(deps: DataFrame) -> DataFrame:
    """Distinct framework names of dependency names; the table is a fixed small map, so this is a projection."""
    return deps.select(lookup(rules.FRAMEWORK_OF_DEPENDENCY, F.lower("name")).alias("framework")).where("framework is not null").distinct()


def entrypoints(files: DataFrame, most: int = 12) -> DataFrame:
    # The manifest's keys and endings of scripts.
    package = files.where("path = 'package.json'")
    main = package.select(F.regexp_replace(F.get_json_object("content", "$.main"), r"^\./", "").alias("path"))
    start = F.coalesce(F.get_json_object("content", "$.scripts.start"), F.get_json_object("content", "$.scripts.dev"))
    script = package.select(F.nullif(F.regexp_extract(start, r"([\w./-]+\.(?:ts|js|mjs|cjs))", 1), F.lit("")).alias("path"))
    by_path = files.where(reduce(lambda a, b: a | b, [F.col("path").rlike(p) for p in rules.ENTRYPOINT_PATHS])).select("path")
    return main.unionByName(script).unionByName(by_path).where("path is not null").distinct().orderBy("path").limit(most)


def _route_of_path(path: Column) -> Column:
    # Folders and file names of routes, and how their segments read as a path.
    app = F.regexp_extract(path, r"^(?:src/)?app/(.+)/route\.(?:ts|js|tsx|jsx)$", 1)
    api = F.regexp_extract(path, r"^(?:src/)?pages/api/(.+)\.(?:ts|js)$", 1)
    app_path = F.regexp_replace(F.regexp_replace(F.regexp_replace(app, r"\[\.\.\.(\w+)\]", "*"), r"\[(\w+)\]", ":$1"), r"\(\w+\)/", "")
    api_path = F.regexp_replace(F.regexp_replace(api, r"\[(\w+)\]", ":$1"), r"/index$", "")
    return F.when(app != "", F.concat(F.lit("/"), app_path)).when(api != "", F.concat(F.lit("/api/"), api_path))


def routes(files: DataFrame, most: int | None = 300) -> DataFrame:
    """method, path, file, line: file-system routes, else six families of calls; the first of a raw method and path wins,
    and only then ROUTE and ALL become ANY. `most` is the reference's bound on a report (None: all)."""
    code = files.where(~F.col("is_test") & is_code(F.col("lang"))).select(F.col("path").alias("file"), "content").withColumn("__fs", _route_of_path(F.col("file")))
    parts = [code.where("__fs is not null").select("file", F.lit(0).alias("__o"), F.lit(0).alias("__i"), F.lit("ANY").alias("raw"), F.col("__fs").alias("path"), F.lit(1).alias("line"))]
    rest = code.where("__fs is null")
    for order, (pattern, method, path) in enumerate(rules.ROUTES, 1):
        rows = _matches(rest, pattern, [0, *([method] if method else []), path], ["m0", *(["m1"] if method else []), "path"])
        # The line of match i: newlines in the pieces up to it and in the matches before it.
        pieces, matches = F.split("content", pattern), F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
        before = F.aggregate(F.slice(pieces, F.lit(1), F.col("__i") + 1), F.lit(0), lambda n, p: n + newlines(p)) + F.aggregate(F.slice(matches, F.lit(1), F.col("__i")), F.lit(0), lambda n, p: n + newlines(p))
        raw = F.upper("m1") if method else F.lit("ANY")
        rows = rows.select("file", F.lit(order).alias("__o"), "__i", raw.alias("raw"), "path", (before + 1).alias("line"))
        parts.append(rows if not method else rows.where(F.col("path").startswith("/")))
    every = _first(reduce(DataFrame.unionByName, parts), ["raw", "path"], ["file", "__o", "__i"])
    out = every.select(F.when(F.col("raw").isin("ROUTE", "ALL"), "ANY").otherwise(F.col("raw")).alias("method"), "path", "file", F.col("line").cast("int").alias("line"), "__o", "__i")
    return (out.orderBy("file", "__o", "__i").limit(most) if most else out).drop("__o", "__i")


def table_facts(files: DataFrame, columns: int = 24) -> DataFrame:
    """name, columns, source: SQL DDL, and the model declarations of five libraries; the first of a name wins.

    A model of the class-based kind ends at the next top-level class or at the end of the file.
    """
    base = files.select(F.col("path").alias("source"), "content")
    inner = lambda body, pattern: F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
    sql_columns = F.filter(F.transform(F.split("body", "\n"), lambda x: F.regexp_extract(x, r"^\s*[\"'`]?(\w+)[\"'`]?\s+\w", 1)), lambda c: (c != "") & ~c.rlike(r"(?i)^(PRIMARY|FOREIGN|UNIQUE|CONSTRAINT|CHECK|INDEX)$"))
    none = F.array().cast("array<string>")
    # Fixed values: (pattern, group of the name, group of the body, columns, how the name is made).
    kinds = (
        (r"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[\"'`]?([\w.]+)[\"'`]?\s*\(([\s\S]*?)\n\s*\)", 1, 2, sql_columns, None),
        (r"(?m)^model\s+(\w+)\s*\{([\s\S]*?)^\}", 1, 2, inner(F.col("body"), r"(?m)^\s*(\w+)\s+\w"), None),
        (r"\w+\s*=\s*(?:pg|mysql|sqlite)Table\s*\(\s*[\"'`](\w+)[\"'`]\s*,\s*\{([\s\S]*?)\n\s*\}", 1, 2, inner(F.col("body"), r"(?m)^\s*(\w+)\s*:"), None),
        (r"__tablename__\s*=\s*[\"'](\w+)[\"']", 1, 0, none, None),
        (r"(?m)^class\s+(\w+)\s*\(\s*(?:models\.)?Model\s*\)\s*:([\s\S]*?)(?=^class|\z)", 1, 2, inner(F.col("body"), r"(?m)^\s{4}(\w+)\s*=\s*models\."), "lower"),
        (r"new\s+(?:mongoose\.)?Schema\s*\(\s*\{([\s\S]*?)\n\s*\}", 0, 1, inner(F.col("body"), r"(?m)^\s*(\w+)\s*:"), "schema"),
    )
    parts = []
    for order, (pattern, name, body, found, how) in enumerate(kinds):
        rows = _matches(base, pattern, [name, body], ["name", "body"])
        if how == "schema":
            rows = rows.withColumn("name", F.regexp_extract("content", r"(?:const|let|var)\s+(\w+)Schema", 1))
        label = F.lower("name") if how else F.col("name")
        parts.append(rows.select("source", F.lit(order).alias("__o"), "__i", F.regexp_replace(label, r"[\"'`\[\]]", "").alias("name"), F.slice(found, 1, columns).alias("columns")))
    return _first(reduce(DataFrame.unionByName, parts).where("name != ''"), ["name"], ["source", "__o", "__i"]).select("name", "columns", "source")


def env_vars(files: DataFrame) -> DataFrame:
    """Distinct upper-case names read from the environment, and keys of .env.example files."""
    lists = []
    for pattern in rules.ENV_NAMES:
        for group in range(1, re.compile(pattern).groups + 1):
            lists.append(F.regexp_extract_all("content", F.lit(pattern), F.lit(group)))
    sample = F.when(F.col("path").rlike(r"\.env\.(example|sample|template)$"), F.regexp_extract_all("content", F.lit(r"(?m)^\s*([A-Z][A-Z0-9_]*)\s*="), F.lit(1))).otherwise(F.array().cast("array<string>"))
    read = F.filter(F.flatten(F.array(*lists)), lambda n: (F.length(n) > 1) & n.rlike("^[A-Z][A-Z0-9_]*$"))
    return files.select(F.explode(F.concat(read, sample)).alias("name")).distinct()


def by_path(files: DataFrame, table: tuple[tuple[str, str], ...], name: str) -> DataFrame:
    """Distinct labels of the rules whose pattern a path matches."""
    labels = F.filter(F.array(*[F.when(F.col("path").rlike(p), F.lit(v)) for p, v in table]), lambda x: x.isNotNull())
    return files.select(F.explode(labels).alias(name)).distinct()


def docker_flags(files: DataFrame) -> DataFrame:
    # File names.
    return files.agg(F.coalesce(F.bool_or(F.lower(file_name(F.col("path"))).startswith("dockerfile")), F.lit(False)).alias("has_dockerfile"), F.coalesce(F.bool_or(file_name(F.col("path")).rlike(r"^(docker-)?compose.*\.ya?ml$")), F.lit(False)).alias("has_compose"))


def description(files: DataFrame) -> Column:
    """The package's description, else null; an aggregate expression."""
    return F.max(F.when(F.col("path") == "package.json", F.get_json_object("content", "$.description")))


def all_facts(files: DataFrame, routes_most: int | None = 300) -> DataFrame:
    """One row: every fact as sorted arrays and counts. Each part is aggregated to one row before they meet."""

    def listed(df: DataFrame, name: str, *cols: str) -> DataFrame:
        item = F.struct(*cols) if len(cols) > 1 else F.col(cols[0])
        return df.agg(F.array_sort(F.collect_list(item)).alias(name))

    totals = files.agg(F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc"), F.count("*").alias("files"), F.count_if("is_test").alias("test_files"), description(files).alias("description"))
    deps = dependencies(files)
    parts = [
        totals, listed(census(files), "languages", "lang", "files", "loc", "share"), listed(deps, "dependencies", "ecosystem", "name", "version", "dev"), listed(frameworks(deps), "frameworks", "framework"),
        listed(entrypoints(files), "entrypoints", "path"), listed(routes(files, routes_most), "routes", "file", "line", "method", "path"), listed(table_facts(files), "tables", "name", "columns", "source"),
        listed(env_vars(files), "env", "name"), listed(by_path(files, rules.CI_PATHS, "ci"), "ci", "ci"), listed(by_path(files, rules.IAC_PATHS, "iac"), "iac", "iac"), docker_flags(files),
    ]
    return reduce(lambda a, b: a.join(b, how="cross"), parts)  # one row each


def churn(log: DataFrame, most: int = 20) -> DataFrame:
    """path, changes: the most changed paths of a commit log (commit, author, at, path)."""
    return log.where("path is not null").groupBy("path").agg(F.count("*").alias("changes")).orderBy(F.desc("changes"), "path").limit(most)
