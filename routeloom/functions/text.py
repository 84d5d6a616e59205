"""Snippets, identifiers and digests, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from routeloom.functions.routes import strip


def compact(c: Column) -> Column:
    """White space runs made one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(" "))


def truncate(c: Column, limit: int) -> Column:
    """At most ``limit`` characters; what is cut ends in three dots."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def snippet(c: Column, limit: int = 220) -> Column:
    return truncate(compact(c), limit)


def id_token(c: Column) -> Column:
    """Lower case, with blanks, slashes and colons as underscores."""
    return F.coalesce(F.nullif(F.translate(F.lower(strip(c)), " /\\:", "____"), F.lit("")), F.lit("unknown"))


def node_id(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *[id_token(F.coalesce(p, F.lit("?"))) for p in parts])


def scenario_id(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("scenario"))


def workspace_id(names: Column, roots: Column) -> Column:
    """Aggregate: sixteen hex digits that stand for a set of repositories, in any order."""
    lines = F.array_sort(F.collect_list(F.concat(names, F.lit("="), roots)))
    return F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 16)


def fenced_body(c: Column) -> Column:
    """Text without the code fence around it."""
    return F.regexp_replace(strip(c), r"(?s)^```[A-Za-z0-9_-]*\s*\n?(.*?)\n?\s*```$", "$1")


def json_payload(c: Column) -> Column:
    """The JSON in a model's answer, as a variant: all of it, or its outermost object or list; else null."""
    body = fenced_body(c)
    whole = F.try_parse_json(body)
    inner = [F.try_parse_json(F.nullif(F.regexp_extract(body, p, 0), F.lit(""))) for p in (r"(?s)\{.*\}", r"(?s)\[.*\]")]
    return F.coalesce(whole, *inner)


def dedupe_strings(c: Column) -> Column:
    """Distinct non-blank strings, stripped, in order."""
    return F.array_distinct(F.filter(F.transform(c, strip), lambda s: s != ""))
