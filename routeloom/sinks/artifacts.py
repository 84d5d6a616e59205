"""Run artifacts: JSON tables by workspace and run, with an index."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.operators.relational import first_per_key

INDEX = "workspace_id string, run_id string, artifact_name string, relative_path string, saved_at string"


def new_run_id(now: datetime | None = None) -> str:
    return f"{(now or datetime.now(UTC)):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """The index: the latest entry for each artifact of a run. Entries are only ever added, so none is lost to a failure or to another writer;
    without any, or if some are malformed, what can be read."""
    try:
        rows = spark.read.schema(INDEX).option("mode", "DROPMALFORMED").json(f"{root}/index").filter("run_id IS NOT NULL")
    except AnalysisException as e:  # the folder does not exist yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INDEX)
    return first_per_key(rows, ["workspace_id", "run_id", "artifact_name"], -F.unix_micros(F.to_timestamp("saved_at")))


def save_artifact(df: DataFrame, root: str, workspace_id: str, run_id: str, name: str) -> str:
    """Write ``df`` as JSON lines below ``root`` and add it to the index, in place of an entry of the same name. Null fields are left out."""
    relative = f"artifacts/{workspace_id}/{run_id}/{name}"
    df.write.mode("overwrite").json(f"{root}/{relative}")
    row = (workspace_id, run_id, name, relative, datetime.now(UTC).isoformat())
    df.sparkSession.createDataFrame([row], INDEX).coalesce(1).write.mode("append").json(f"{root}/index")
    return relative


def artifacts_of(spark: SparkSession, root: str, workspace_id: str, run_id: str) -> DataFrame:
    """``artifact_name, relative_path, saved_at`` of a run's artifacts, by name."""
    own = read_index(spark, root).filter((F.col("workspace_id") == workspace_id) & (F.col("run_id") == run_id))
    return own.select("artifact_name", "relative_path", "saved_at").orderBy("artifact_name")


def read_artifact(spark: SparkSession, root: str, workspace_id: str, run_id: str, name: str) -> DataFrame:
    """The rows of an artifact, as they were saved."""
    hit = read_index(spark, root).filter((F.col("workspace_id") == workspace_id) & (F.col("run_id") == run_id) & (F.col("artifact_name") == name)).first()
    if hit is None:
        raise ValueError(f"run {run_id} has no artifact {name}")
    return spark.read.json(f"{root}/{hit['relative_path']}")


def runs(spark: SparkSession, root: str, workspace_id: str) -> DataFrame:
    """Runs of a workspace, the latest first."""
    own = read_index(spark, root).filter(F.col("workspace_id") == workspace_id)
    return own.groupBy("run_id").agg(F.max("saved_at").alias("saved_at"), F.count(F.lit(1)).alias("artifacts")).orderBy(F.desc("saved_at"), F.desc("run_id"))


def artifact_metadata(payload: Column) -> Column:
    """``struct(repos, method, path, timestamp)`` of a stored artifact, a variant: its own fields, else those of the result within it."""
    at = lambda *paths: F.coalesce(*[F.try_variant_get(payload, p, "string") for p in paths])
    lists = [F.try_variant_get(payload, p, "array<struct<name:string,root:string>>") for p in ("$.repo_inputs", "$.result.repos")]
    return F.struct(
        F.coalesce(*lists, F.array().cast("array<struct<name:string,root:string>>")).alias("repos"), at("$.target.method", "$.result.target.method").alias("method"), at("$.target.path", "$.result.target.path").alias("path"),
        F.coalesce(F.nullif(at("$.timestamp"), F.lit("")), F.nullif(at("$.artifact_metadata.timestamp"), F.lit(""))).alias("timestamp"),
    )


def postman_path(c: Column) -> Column:
    p = F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("/"))
    return F.regexp_replace(F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)), "/{2,}", "/")


def scenario_requests(scenarios: DataFrame) -> DataFrame:
    """``scenarios`` (request_method, request_path, method, route, route_method, route_path, headers, category, contract_refs) with the ``method`` and ``path`` that they
    ask for, and ``needs_auth``: the request's own, else the scenario's, else the route's."""
    said = lambda *cols: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols])
    auth = F.coalesce(F.map_contains_key("headers", F.lit("Authorization")), F.lit(False)) | F.lower(F.coalesce("category", F.lit(""))).isin("auth", "authorization")
    refs = F.coalesce(F.array_contains("contract_refs", "request.headers.Authorization"), F.lit(False))
    return scenarios.withColumns({
        "method": F.upper(F.coalesce(said("request_method", "method", "route_method"), F.lit("GET"))), "path": postman_path(said("request_path", "route", "route_path")), "needs_auth": auth | refs,
    })


def postman_items(scenarios: DataFrame) -> DataFrame:
    """Collection items of ``scenarios`` (name, method, path, query map, headers map, body, needs_auth, summary, ord)."""
    path, query = postman_path(F.col("path")), F.map_entries(F.coalesce("query", F.create_map().cast("map<string,string>")))
    pairs = F.array_join(F.transform(query, lambda e: F.concat_ws("=", e["key"], e["value"])), "&")
    raw = F.concat(F.lit("{{baseUrl}}"), path, F.when(pairs != "", F.concat(F.lit("?"), pairs)).otherwise(""))
    given = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    extra = lambda cond, k, v: F.when(cond & ~F.map_contains_key(given, k), F.create_map(F.lit(k), F.lit(v))).otherwise(F.create_map().cast("map<string,string>"))
    headers = F.map_concat(given, extra(F.coalesce("needs_auth", F.lit(False)), "Authorization", "Bearer {{authToken}}"), extra(F.col("body").isNotNull(), "Content-Type", "application/json"))
    listed = lambda m: F.transform(m, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    request = F.struct(
        F.upper(F.coalesce("method", F.lit("GET"))).alias("method"), listed(F.map_entries(headers)).alias("header"),
        F.struct(raw.alias("raw"), F.array(F.lit("{{baseUrl}}")).alias("host"), F.filter(F.split(path, "/"), lambda s: s != "").alias("path"), F.when(F.size(query) > 0, listed(query)).alias("query")).alias("url"),
        F.when(F.col("body").isNotNull(), F.struct(F.lit("raw").alias("mode"), F.col("body").alias("raw"))).alias("body"), F.col("summary").alias("description"),
    )
    return scenarios.select("ord", F.struct("name", request.alias("request")).alias("item"))


def postman_collection(scenarios: DataFrame, name: str) -> DataFrame:
    """One row: the collection as JSON."""
    items = postman_items(scenarios).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))), lambda x: x["item"]).alias("item"))
    info = F.struct(F.lit(name).alias("name"), F.lit("https://schema.getpostman.com/json/collection/v2.1.0/collection.json").alias("schema"))
    return items.select(F.to_json(F.struct(info.alias("info"), "item")).alias("collection"))
