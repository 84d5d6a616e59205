"""Cached discoveries: artifacts with a manifest of the files they were made from, used again while nothing has changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.functions.kinds import suffix
from routeloom.functions.text import workspace_id
from routeloom.operators.relational import snapshot_diff

# Files that a discovery depends on, artifacts of a bundle, and the one that may be missing.
RELEVANT = (".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rb", ".php", ".cs", ".kt", ".json", ".toml", ".yml", ".yaml", ".xml")
ARTIFACTS = ("repo_map", "route_index", "route_graph_facts", "discovery_coverage", "routing_pattern_plan", "routing_pattern_execution", "routes_discovery")
OPTIONAL = ("routing_pattern_execution",)
#: Bundles of another version are not used.
VERSION = "1"
_MANIFEST = "version string, policy string, model string, artifacts array<string>, saved_at timestamp"


@dataclass(frozen=True)
class Status:
    hit: bool
    reason: str
    changed: int = 0


def is_relevant(path: Column) -> Column:
    return suffix(path).isin(*RELEVANT)


def snapshot(files: DataFrame) -> DataFrame:
    """``repo, path, mtime, size, sha`` of the files (repo, path, mtime, size, sha256) that a discovery depends on."""
    return files.filter(is_relevant(F.col("path"))).select("repo", "path", "mtime", "size", F.col("sha256").alias("sha"))


def cache_folder(repos: DataFrame, root: str, workspace: str) -> str:
    """The folder of a set of repositories (name, root), in whatever order they are given."""
    key = repos.agg(workspace_id(F.col("name"), F.col("root"))).first()[0]
    return f"{root}/{workspace}/cache/discovery/{key}"


def save_bundle(folder: str, files: DataFrame, artifacts: dict[str, DataFrame], *, policy: str, model: str | None = None) -> None:
    """Write artifacts and the snapshot of their files; the manifest last, so that a bundle without one is not whole."""
    spark = files.sparkSession
    for name, df in artifacts.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
    snapshot(files).write.mode("overwrite").parquet(f"{folder}/files")
    row = spark.createDataFrame([(VERSION, policy, model, sorted(artifacts))], "version string, policy string, model string, artifacts array<string>")
    row.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def load_bundle(spark: SparkSession, folder: str, files: DataFrame, *, policy: str, model: str | None = None) -> tuple[Status, dict[str, DataFrame] | None]:
    """The artifacts of a bundle if it is of this version, policy and model, its files are those of now and it is whole; else why not.

    A file whose time or size differs counts as unchanged if its digest agrees. Only the number of changed files reaches the driver.
    """
    try:
        manifest = spark.read.schema(_MANIFEST).json(f"{folder}/manifest").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return Status(False, "cache_missing"), None
    if manifest is None or manifest["version"] is None:
        return Status(False, "manifest_invalid"), None
    for found, wanted, reason in ((manifest["version"], VERSION, "version_mismatch"), (manifest["policy"], policy, "policy_mismatch"), (manifest["model"], model, "model_mismatch")):
        if found != wanted:
            return Status(False, reason), None
    changed = snapshot_diff(spark.read.parquet(f"{folder}/files"), snapshot(files)).count()
    if changed:
        return Status(False, "changed_files", changed), None
    missing = next((name for name in ARTIFACTS if name not in OPTIONAL and name not in manifest["artifacts"]), None)
    if missing:
        return Status(False, f"missing_artifact:{missing}"), None
    return Status(True, "cache_hit"), {name: spark.read.json(f"{folder}/{name}") for name in manifest["artifacts"]}
