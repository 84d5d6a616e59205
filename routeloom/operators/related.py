"""Files near an endpoint: what else is read to tell its flow, and which files a model is shown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions.kinds import basename, file_role
from routeloom.operators.relational import top_k

# Words in the paths of files that routes lean on, and the least score that counts.
KEYWORDS = ("service", "services", "client", "clients", "db", "database", "model", "models", "repository", "repositories", "repo", "dao", "store", "query", "queries")
LEAST_SCORE = 4.2


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def _ending(name: Column) -> Column:
    return F.regexp_extract(name, r".(\.[^.]+)$", 1)


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def symbol_words(handler: Column, evidence: Column) -> Column:
    """Parts of three letters or more of a handler's name and of the symbols of its evidence."""
    parts = lambda c: F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9_]+")
    every = F.concat(parts(handler), F.coalesce(F.flatten(F.transform(evidence, lambda e: parts(e["symbol"]))), F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda w: F.length(w) >= 3))


def related_files(endpoints: DataFrame, files: DataFrame, limit: int = 1) -> DataFrame:
    """``endpoint_id, repo, path, score, reasons, rank``: the files that stand closest to an endpoint's own, ``limit`` at most.

    ``endpoints``: endpoint_id, repo, file, handler, evidence. ``files``: repo, path. A file counts from :data:`LEAST_SCORE` on, and only with a keyword or a
    symbol in its name. An endpoint meets the files of its repository; they are cut to the limit before they are shuffled.
    """
    e = endpoints.select("endpoint_id", "repo", F.col("file").alias("_anchor"), symbol_words(F.col("handler"), F.col("evidence")).alias("_words"))
    low, own = F.lower("path"), F.lower("_anchor")
    name, own_name = basename(low), basename(own)
    parts = F.split(low, "/")
    hits = reduce(lambda a, b: a + b, [(F.array_contains(parts, k) | name.contains(k)).cast("int") for k in KEYWORDS])
    words = F.size(F.filter("_words", lambda w: name.contains(w)))
    rules = {
        "same_directory": (_folder(low) == _folder(own), F.lit(3.0)),
        "same_extension": (_ending(name) == _ending(own_name), F.lit(0.7)),
        "same_top_level_dir": (F.element_at(parts, 1) == F.element_at(F.split(own, "/"), 1), F.lit(0.6)),
        "related_filename_keyword": (hits > 0, F.least(F.lit(2.0), F.lit(0.9) + F.lit(0.3) * hits)),
        "name_matches_anchor": ((_stem(own_name) != "") & name.contains(_stem(own_name)) & (_stem(name) != _stem(own_name)), F.lit(0.7)),
        "name_matches_symbol": (words > 0, F.least(F.lit(2.4), F.lit(1.0) + F.lit(0.4) * words)),
    }
    score = reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0.0) for c, w in rules.values()])
    reasons = F.array_remove(F.array(*[F.when(rules[r][0], F.lit(r)).otherwise(F.lit("")) for r in sorted(rules)]), "")
    near = e.join(files.select("repo", "path"), "repo").filter(F.col("path") != F.col("_anchor")).withColumns({"score": F.round(score, 6), "reasons": reasons})
    strong = near.filter((F.col("score") >= LEAST_SCORE) & F.arrays_overlap("reasons", F.array(F.lit("name_matches_symbol"), F.lit("related_filename_keyword"))))
    return top_k(strong, ["endpoint_id"], [F.desc("score"), F.col("path")], limit).select("endpoint_id", "repo", "path", "score", "reasons", "rank")


def context_files(endpoints: DataFrame, files: DataFrame, limit: int = 1) -> DataFrame:
    """``endpoint_id, pos, repo, path, reasons, text``: an endpoint's own file first, then those related to it. ``files``: repo, path, text.

    Files without text cannot be read and are left out.
    """
    own = endpoints.select("endpoint_id", "repo", F.col("file").alias("path"), F.lit(0).alias("pos"), F.array(F.lit("anchor")).alias("reasons"))
    others = related_files(endpoints, files, limit).select("endpoint_id", "repo", "path", F.col("rank").alias("pos"), "reasons")
    return own.unionByName(others).join(files.filter("text IS NOT NULL").select("repo", "path", "text"), ["repo", "path"]).select("endpoint_id", "pos", "repo", "path", "reasons", "text")


def shown_files(reads: DataFrame, limit: int = 5) -> DataFrame:
    """The first ``limit`` files of each repository that a model is shown, of ``reads`` (repo, path, ord): sources first, then those of no known role.

    Tests and documentation are never shown; skipped reads (text null) neither.
    """
    role = file_role(F.col("path"))
    rows = reads.filter("text IS NOT NULL").withColumn("_role", F.when(role == "source_route_candidate", 0).when(role == "unknown", 1)).filter("_role IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("repo").orderBy("_role", "ord"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("_role")
