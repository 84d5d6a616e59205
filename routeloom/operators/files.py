"""Files of repositories: sensing, ranking and counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions.kinds import any_of, basename, ends_with_any, file_role, suffix
from routeloom.operators.relational import top_k

# Weights of path words, bootstrap files and extensions.
PATH_WEIGHTS = {
    "route": 2.0, "routes": 2.0, "router": 2.0, "controller": 1.8, "controllers": 1.8, "handler": 1.6, "handlers": 1.6, "api": 1.6,
    "view": 1.0, "views": 1.0, "endpoint": 1.6, "endpoints": 1.6, "server": 1.4, "main": 1.2, "app": 1.2,
}
BOOTSTRAP_WEIGHTS = {
    "main.py": 2.6, "app.py": 2.4, "server.py": 2.4, "server.js": 2.4, "server.ts": 2.4, "main.go": 2.6, "main.rs": 2.6, "index.js": 1.8, "index.ts": 1.8,
}
EXTENSION_WEIGHTS = {".py": 1.0, ".ts": 1.0, ".tsx": 0.8, ".js": 0.8, ".go": 1.0, ".rs": 1.0, ".java": 0.8, ".kt": 0.8}
ROLE_WEIGHTS = {"source_route_candidate": 0.5, "test_usage_candidate": -8.0, "docs_candidate": -8.0, "unknown": -0.3}
SOURCE_DIRS = ("src", "app", "api", "server", "backend", "services")
# What an extension tells of a language, and the names that tell of a backend.
FAMILIES = {
    ".py": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".rb": "ruby", ".php": "php", ".cs": "dotnet", ".scala": "scala",
}
BACKEND_NAMES = ("api", "server", "backend", "controllers", "routes", "handlers", "main.py", "app.py", "server.js", "server.ts")
MANIFESTS = (
    "package.json", "pyproject.toml", "requirements.txt", "Pipfile", "go.mod", "Cargo.toml", "pom.xml", "build.gradle", "Gemfile", "composer.json",
)
_TEST_MARKS, _DOCS_MARKS = ("tests/", "test/", "__tests__/", "spec/"), ("docs/", "readme.md")
_TEST_ENDS = (".test.ts", ".spec.ts", ".test.js", ".spec.js", ".test.jsx", ".spec.jsx", ".test.tsx", ".spec.tsx")


def sense(files: DataFrame) -> DataFrame:
    """Per repo of ``files`` (repo, path): ``files, dominant`` (the eight commonest extensions, ties by name), ``families, backend, manifests``.

    Extensions are counted before anything is gathered, so a repo's row is made of a few counts, not of its files.
    """
    parts = F.split(F.col("path"), "/")
    known = F.array(*map(F.lit, BACKEND_NAMES))
    counted = files.groupBy("repo", suffix(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))
    common = top_k(counted.filter("ext <> ''"), ["repo"], [F.col("n").desc(), F.col("ext")], 8)
    by_ext = counted.withColumn("family", F.try_element_at(F.create_map(*[F.lit(x) for p in FAMILIES.items() for x in p]), F.col("ext"))).groupBy("repo").agg(
        F.sum("n").alias("files"), F.array_sort(F.collect_set("family")).alias("families")
    )
    dominant = common.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ext", "n"))), lambda x: F.struct(x["ext"].alias("ext"), x["n"].alias("n"))).alias("dominant"))
    seen = files.select("repo", F.explode(F.array_union(F.array_intersect(parts, known), F.when((F.size(parts) == 1) & basename(F.col("path")).isin(*MANIFESTS), parts).otherwise(F.array().cast("array<string>")))).alias("name"))
    named = seen.distinct().groupBy("repo").agg(
        F.array_sort(F.collect_list(F.when(F.col("name").isin(*BACKEND_NAMES), F.col("name")))).alias("backend"),
        F.array_sort(F.collect_list(F.when(F.col("name").isin(*MANIFESTS), F.col("name")))).alias("manifests"),
    )
    none = F.array().cast("array<string>")
    return by_ext.join(dominant, "repo", "left").join(named, "repo", "left").withColumns(
        {c: F.coalesce(c, none) for c in ("backend", "manifests")}
    )


def file_score(path: Column, dominant: Column, families: Column, backend: Column) -> Column:
    """How likely a file declares routes, by its path and what its repo is like. Weights add up."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name, parts, ext = basename(low), F.split(low, "/"), suffix(low)
    when = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    of = lambda c, table, rest=0.0: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), c), F.lit(rest))
    score = F.lit(0.0)
    for word, weight in PATH_WEIGHTS.items():
        score = score + when(F.array_contains(parts, word) | name.contains(word), weight)
    score = score + of(name, BOOTSTRAP_WEIGHTS)
    score = score + when(F.arrays_overlap(parts, F.array(*map(F.lit, SOURCE_DIRS))), 0.7)
    score = score + when(F.size(parts) <= 2, 0.6) + of(ext, EXTENSION_WEIGHTS)
    score = score + when(F.array_contains(dominant, ext), 0.4)
    score = score + when(F.array_contains(families, of(ext, FAMILIES, "")), 0.6)
    score = score + when(F.exists(backend, lambda s: F.array_contains(parts, s) | F.contains(name, s)), 0.8)
    score = score + of(file_role(path), ROLE_WEIGHTS)
    for bad in (
        any_of(low, _TEST_MARKS), name.startswith("test_") & name.endswith(".py"), name.endswith("_test.py"), ends_with_any(name, _TEST_ENDS),
        any_of(low, _DOCS_MARKS), ends_with_any(name, (".md", ".rst", ".adoc")),
    ):
        score = score - when(bad, 5.0)
    return score


def rank_files(files: DataFrame, sensed: DataFrame, k: int = 60, least: float = 0.1) -> DataFrame:
    """The ``k`` best files of each repo: ``repo, path, score, role, rank``; ties by path. Scores under ``least`` are out, before rounding."""
    of_repo = sensed.select("repo", F.col("dominant")["ext"].alias("_dominant"), F.col("families").alias("_families"), F.col("backend").alias("_backend"))
    rows = files.join(of_repo, "repo").withColumn("_score", file_score(F.col("path"), F.col("_dominant"), F.col("_families"), F.col("_backend")))
    rows = rows.filter(F.col("_score") >= least).select("repo", "path", F.round("_score", 3).alias("score"), file_role(F.col("path")).alias("role"))
    return top_k(rows, ["repo"], [F.col("score").desc(), F.col("path")], k)


def index_summary(facts: DataFrame) -> DataFrame:
    """Sums of array sizes per repo, and over all repos in a row of null: facts (repo, route_calls, mount_calls, router_symbols)."""
    n = lambda c: F.sum(F.size(c)).alias(f"{c}_n")
    return facts.rollup("repo").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.size("route_calls") > 0).alias("files_with_route_calls"), n("route_calls"), n("mount_calls"), n("router_symbols")
    )


def representative(facts: DataFrame, by: list, spread: str, order: list, k: int) -> DataFrame:
    """Up to ``k`` rows per group, one for each value of ``spread``, in order."""
    one = top_k(facts, [*by, spread], order, 1).drop("rank")
    return top_k(one, by, order, k)


# Directories that a repository map leaves out, words that tell of folders, manifests, entry points, and suffixes of text.
MAP_SKIPPED = (
    ".git", "node_modules", "dist", "build", ".next", "coverage", ".venv", "venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "target", "out", "bin", "obj", "vendor",
)
ROUTE_WORDS = ("routes", "router", "routers", "api", "apis", "endpoints")
CONTROLLER_WORDS = ("controllers", "controller", "handlers", "views")
BACKEND_WORDS = ("routes", "router", "routers", "api", "apis", "controllers", "controller", "server", "backend", "app", "src", "handlers", "views", "endpoints")
SIDE_WORDS = ("docs", "test", "tests", "__tests__", "examples", "fixtures", "mocks")
MAP_MANIFESTS = (
    "package.json", "tsconfig.json", "nest-cli.json", "pyproject.toml", "requirements.txt", "setup.py", "manage.py", "pom.xml", "build.gradle", "settings.gradle", "go.mod", "cargo.toml", "docker-compose.yml", "dockerfile",
)
ENTRY_POINTS = ("app.ts", "app.js", "server.ts", "server.js", "main.py", "app.py", "manage.py", "application.java", "main.go")
TEXT_SUFFIXES = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rb", ".php", ".cs", ".kt", ".json", ".toml", ".yaml", ".yml", ".xml", ".md", ".rst",
)


def is_entry_point(path: Column) -> Column:
    low = F.lower(path)
    return basename(low).isin(*ENTRY_POINTS) | low.contains("src/main")


def _of_map(files: DataFrame) -> DataFrame:
    """Files below no skipped directory, in any case of its name, with their folder."""
    folders = F.slice(F.split(F.lower("path"), "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    kept = files.filter(~F.arrays_overlap(folders, F.array(*map(F.lit, MAP_SKIPPED))))
    return kept.withColumn("folder", F.coalesce(F.nullif(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit("")), F.lit(".")))


def folder_map(files: DataFrame) -> DataFrame:
    """``repo, folder, depth, files, signals, is_backend, is_route, is_controller`` of the folders that hold files, signals from the words in their path."""
    parts = F.filter(F.split(F.lower("folder"), "/"), lambda p: (p != "") & (p != "."))
    has = lambda words: F.arrays_overlap(F.col("_parts"), F.array(*map(F.lit, words)))
    told = F.array(*map(F.lit, sorted({*BACKEND_WORDS, *SIDE_WORDS})))
    counted = _of_map(files).groupBy("repo", "folder").agg(F.count(F.lit(1)).alias("files")).withColumn("_parts", parts)
    return counted.select(
        "repo", "folder", F.size("_parts").alias("depth"), "files", F.transform(F.array_sort(F.array_intersect("_parts", told)), lambda p: F.concat(F.lit("path:"), p)).alias("signals"),
        has(BACKEND_WORDS).alias("is_backend"), has(ROUTE_WORDS).alias("is_route"), has(CONTROLLER_WORDS).alias("is_controller"),
    )


def repository_map(files: DataFrame) -> DataFrame:
    """Per repo: ``total_files, included, skipped, manifests, entry_points``; files without a suffix are included, of others those of text.

    Manifests and entry points are few names among many files, so only they are gathered.
    """
    ext, name = suffix(F.col("path")), basename(F.lower("path"))
    rows = _of_map(files).withColumn("_in", (ext == "") | ext.isin(*TEXT_SUFFIXES))
    listed = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("path"))))
    return rows.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if("_in").alias("included"), F.count_if(~F.col("_in")).alias("skipped"),
        listed(F.col("_in") & name.isin(*MAP_MANIFESTS)).alias("manifests"), listed(F.col("_in") & is_entry_point(F.col("path"))).alias("entry_points"),
    )
