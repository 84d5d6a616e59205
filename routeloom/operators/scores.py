"""Scores and labels, as column arithmetic. Rounding is Spark's, half away from zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions.kinds import chain


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Into the range; null is 0."""
    return F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(low)), F.lit(high))


def discovery_coverage(df: DataFrame) -> DataFrame:
    """Adds ``score, label, skip_model`` to rows of counts: files_with_route_calls, route_calls, declarations, mount_edges, composed, unresolved, deterministic, truncated.

    The label is that of the score before rounding.
    """
    n = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    found, volume = n("deterministic"), F.greatest(n("route_calls"), n("declarations"), n("files_with_route_calls"))
    recovery = F.when(volume > 0, F.least(F.lit(1.0), found / volume)).when(found > 0, 1.0).otherwise(0.0)
    compose = F.when(n("declarations") > 0, F.least(F.lit(1.0), n("composed") / n("declarations"))).when(found > 0, 1.0).otherwise(0.0)
    open_ = F.when(n("mount_edges") + n("unresolved") > 0, F.least(F.lit(1.0), n("unresolved") / (n("mount_edges") + n("unresolved")))).otherwise(0.0)
    score = F.lit(0.5) * recovery + F.lit(0.3) * compose + F.lit(0.2) * (F.lit(1.0) - open_)
    score = F.when((found > 0) & (volume == 0), F.greatest(score, F.lit(0.82))).when((found == 0) & (volume > 0), F.least(score, F.lit(0.35))).otherwise(score)
    score = score - F.least(F.lit(0.25), F.lit(0.08) * n("truncated"))
    raw = F.col("_raw")
    label = chain([((volume == 0) & (found == 0), "unknown"), (raw >= 0.8, "strong"), (raw >= 0.62, "moderate")], "weak")
    return df.withColumn("_raw", clamp(score)).withColumns({"score": F.round(raw, 2), "label": label}).withColumn("skip_model", F.col("label").isin("strong", "moderate")).drop("_raw")


def trace_confidence(df: DataFrame) -> Column:
    """Confidence of a trace from: selected, has_method_path, has_handler, has_file, has_repo, endpoint_confidence, grounded_steps, weak_steps, steps, sinks, dropped_steps, edges."""
    on = lambda c, w: F.when(F.coalesce(F.col(c), F.lit(False)), w).otherwise(0.0)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    endpoint = F.lit(0.15) + on("has_method_path", 0.12) + on("has_handler", 0.08) + on("has_file", 0.08) + on("has_repo", 0.05)
    endpoint = endpoint + F.coalesce(F.least(F.lit(0.12), F.greatest(F.lit(0.0), F.col("endpoint_confidence")) * 0.12), F.lit(0.0))
    score = F.lit(0.25) + F.when(F.col("selected"), endpoint).otherwise(0.0)
    score = score + F.least(F.lit(0.14), n("grounded_steps") * 0.035) - F.least(F.lit(0.12), n("weak_steps") * 0.03)
    score = score + F.least(F.lit(0.10), n("sinks") * 0.04) + F.when((n("sinks") > 0) & (n("steps") > 0), 0.04).otherwise(0.0)
    score = score - on("dropped_steps", 0.08) - F.when((n("sinks") > 0) & (n("steps") == 0), 0.12).otherwise(0.0)
    score = score + F.least(F.lit(0.08), F.greatest(F.lit(0), n("edges") - 1) * 0.04)
    return F.round(F.least(clamp(score), F.lit(0.95)), 2)


def capped_confidence(base: Column, weak: Column, dropped: Column, sinks_only: Column) -> Column:
    """``struct(confidence, capped, reasons)``: partly inferred traces stay at 0.85 or below."""
    told = ((weak, "inferred steps have weak grounding"), (dropped, "suspicious abstract steps were dropped"), (sinks_only, "flow includes sinks without intermediate steps"))
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in told]))
    high = (F.size(reasons) > 0) & (clamp(base) > 0.85)
    return F.struct(F.when(high, 0.85).otherwise(clamp(base)).alias("confidence"), high.alias("capped"), reasons.alias("reasons"))


def call_confidence(method: Column, path: Column, service: Column) -> Column:
    score = F.lit(0.35) + F.when(method.isNotNull(), 0.2).otherwise(0.0) + F.when(path.isNotNull(), 0.3).otherwise(0.0)
    return F.least(F.lit(0.9), score + F.when(service.isNotNull(), 0.1).otherwise(0.0))


def grounding_label(grounded: Column, inferred: Column, scaffold: Column) -> Column:
    return F.when(grounded >= F.greatest(F.lit(2), inferred + scaffold), "high").when((grounded > 0) | (inferred > 0), "medium").otherwise("low")


def contract_confidence(current: Column, body_fields: Column, statuses: Column, server_response: Column) -> Column:
    up = (statuses > 0) & ((body_fields > 0) | server_response)
    return F.when(current == "high", current).when(up, "medium").otherwise(F.coalesce(F.nullif(current, F.lit("")), F.lit("low")))


#: Surfaces that make a matrix more than generic.
RICH = ("external_api_failure", "database_path", "queue_publish", "cross_repo_contract", "proxy_downstream")


def matrix_coverage(detected: Column, covered: Column, cross_repo: Column, external: Column, sinks: Column) -> Column:
    """Share of the detected surfaces that scenarios cover; generic and sink-aware matrices stay below perfect."""
    share = F.size(F.array_intersect(detected, covered)) / F.greatest(F.lit(1), F.size(detected))
    rich = F.arrays_overlap(detected, F.array(*map(F.lit, RICH)))
    score = F.when(rich, share).otherwise(F.least(F.lit(0.70), F.greatest(F.lit(0.50), share * 0.7)))
    return F.round(F.when((external | sinks) & ~(cross_repo & external), F.least(clamp(score), F.lit(0.95))).otherwise(clamp(score)), 2)


def importance(name: Column, signals: Column) -> Column:
    """How much a call is worth following."""
    n = F.lower(name)
    strong = n.rlike("uploadbase64|uploadbuffer|uploadfile|downloadfile|putobject")
    some = n.rlike("service|repository|repo|upload|storage|client|api|publish|sendemail")
    return (
        F.when(strong, 5).when(some, 3).otherwise(0) + F.when(F.array_contains(signals, "await_call"), 2).otherwise(0)
        + F.when(F.array_contains(signals, "response_return"), 1).otherwise(0)
        - F.when(n.rlike("humanfilesize|getkey|getstorageurl|serverresponse|getrootdir"), 3).otherwise(0)
    )
