"""Steps and sinks as a model tells them: read, made firm, and dropped with a reason where nothing in the code bears them out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions import routes, text
from routeloom.functions.evidence import EVIDENCE
from routeloom.functions.kinds import any_of, chain, sink_action, sink_kind

# Names of steps that say nothing, words that carry no content, and beginnings that code operations have.
ABSTRACT_STEPS = ("call payment client", "call service", "call external api", "invoke client", "process request", "handle request")
GENERIC_WORDS = ("call", "invoke", "process", "handle", "request", "service", "client", "external", "api")
CONCRETE_STARTS = ("create ", "return ", "query ", "insert ", "update ", "delete ", "commit ", "refresh ", "validate ")
# Kinds of steps that a flow may have.
FLOW_KINDS = (
    "endpoint", "handler", "dependency", "input_model", "service_call", "db_read", "db_write", "external_api_call", "queue_publish",
    "queue_consume", "file_write", "validation", "auth", "transform", "unknown",
)
# What shows that a file declares routes, stores something, or calls others.
ANCHOR_SIGNALS = (
    ("router.", "@app.", "route(", "post(", "get(", "put(", "delete("),
    ("db.", ".commit(", ".add(", ".save(", "insert", "update", "delete"),
    ("client.", "requests.", "httpx.", "fetch(", "queue", "publish", "enqueue"),
)
# Fixed value: the label of evidence that was made up for want of any.
DEFAULT_LABEL = "inferred-from-context"


def step_name(c: Column) -> Column:
    """White space collapsed, punctuation off both ends; blank is null."""
    return routes.blank_to_null(F.btrim(text.compact(c), F.lit(" ,;:")))


def literal_text(c: Column) -> Column:
    """Lower-case words of letters and digits."""
    return text.compact(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "))


def status(c: Column) -> Column:
    return F.coalesce(routes.blank_to_null(F.lower(routes.strip(c))), F.lit("inferred"))


def confidence(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def symbol(c: Column) -> Column:
    return routes.blank_to_null(F.btrim(routes.strip(c), F.lit(" ,;:()[]{}")))


def flow_kind(c: Column) -> Column:
    """A kind of :data:`FLOW_KINDS`, by name or by what the name holds."""
    raw = F.coalesce(routes.blank_to_null(F.translate(F.lower(routes.strip(c)), " -", "__")), F.lit("unknown"))
    has = raw.contains
    return chain([
        (raw.isin(*FLOW_KINDS), raw),
        (has("db") | has("database"), chain([(has("read"), "db_read"), (has("write"), "db_write")], "unknown")),
        (has("queue"), chain([(has("publish"), "queue_publish"), (has("consume"), "queue_consume")], "unknown")),
        (has("external") | has("http") | has("api"), "external_api_call"),
        (has("file") & (has("write") | has("save")), "file_write"), (has("handler"), "handler"), (has("service"), "service_call"),
    ], "unknown")


def is_abstract(name: Column) -> Column:
    return literal_text(name).isin(*ABSTRACT_STEPS)


def is_concrete(name: Column) -> Column:
    """Whether a step's name reads like an operation in code."""
    raw, said = F.lower(routes.strip(name)), literal_text(name)
    starts = reduce(lambda a, b: a | b, [said.startswith(p) for p in CONCRETE_STARTS])
    return (said != "") & (raw.contains(".") | (raw.contains("(") & raw.contains(")")) | starts)


def is_supported(name: Column, code: Column) -> Column:
    """Whether ``code`` holds a step's name, in words or as an identifier, or all of its words that mean something."""
    said, low, words = literal_text(name), F.lower(F.coalesce(code, F.lit(""))), literal_text(F.coalesce(code, F.lit("")))
    content = F.filter(F.split(said, " "), lambda w: (F.length(w) >= 4) & ~w.isin(*GENERIC_WORDS))
    return (said != "") & (words.contains(said) | low.contains(F.replace(said, F.lit(" "), F.lit("_"))) | ((F.size(content) > 0) & F.forall(content, lambda w: words.contains(w))))


def has_strong_evidence(sym: Column, evidence: Column) -> Column:
    """Whether a step has a symbol, or evidence with a symbol or a label of its own."""
    label = lambda e: F.lower(routes.strip(F.coalesce(e["label"], F.lit(""))))
    named = lambda c: F.coalesce(c, F.lit("")) != ""
    return named(sym) | F.coalesce(F.exists(evidence, lambda e: named(e["symbol"]) | ((label(e) != "") & (label(e) != DEFAULT_LABEL))), F.lit(False))


def anchor_sufficient(code: Column, truncated: Column) -> Column:
    """Whether a file alone tells a flow: it is there as a whole, and shows two of three kinds of signals."""
    low = F.lower(F.coalesce(code, F.lit("")))
    groups = reduce(lambda a, b: a + b, [any_of(low, g).cast("int") for g in ANCHOR_SIGNALS])
    return code.isNotNull() & ~F.coalesce(truncated, F.lit(False)) & (groups >= 2)


# --- reading answers ---------------------------------------------------------------------------------


def text_field(item: Column, name: str) -> Column:
    """A field of a variant if it is a string that is not blank."""
    value = F.try_variant_get(item, f"$.{name}", "variant")
    said = F.try_variant_get(item, f"$.{name}", "string")
    return F.when((F.schema_of_variant(value) == "STRING") & (routes.strip(said) != ""), said)


def number_field(item: Column, name: str) -> Column:
    """A field of a variant if it is a number."""
    kind = F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(item, f"$.{name}", "double"))


def text_list(item: Column, name: str) -> Column:
    """The strings of a list in a variant; empty if it is no list."""
    found = F.try_variant_get(item, f"$.{name}", "array<variant>")
    kept = F.filter(found, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(kept, lambda v: F.try_variant_get(v, "$", "string")), F.array().cast("array<string>"))


def _evidence(item: Column, file: Column) -> Column:
    """Evidence in a variant, each piece with a file; if there is none, a piece that says so."""
    raw = F.coalesce(F.try_variant_get(item, "$.evidence", "array<variant>"), F.array().cast("array<variant>"))
    piece = lambda v: F.struct(
        F.coalesce(routes.posix_path(text_field(v, "file")), file).alias("file"), symbol(text_field(v, "symbol")).alias("symbol"), text_field(v, "label").alias("label"), F.lit(None).cast("string").alias("snippet")
    )
    objects = F.filter(raw, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    found = F.filter(F.transform(objects, piece), lambda e: e["file"].isNotNull())
    made = F.array(F.struct(file.alias("file"), F.lit(None).cast("string").alias("symbol"), F.lit(DEFAULT_LABEL).alias("label"), F.lit(None).cast("string").alias("snippet")))
    return F.when(F.size(found) > 0, found).when(file.isNotNull(), made).otherwise(F.array().cast(EVIDENCE))


def _items(answers: DataFrame, key: str) -> DataFrame:
    body = text.json_payload(F.col("answer"))
    whole = F.try_variant_get(body, "$", "array<variant>") if key == "steps" else F.lit(None).cast("array<variant>")
    found = F.coalesce(F.try_variant_get(body, f"$.{key}", "array<variant>"), whole)
    return answers.select("flow_id", "repo", F.col("code").alias("_code"), F.posexplode(found).alias("_at", "item"))


def told_steps(answers: DataFrame) -> DataFrame:
    """``flow_id, ord, kind, name, repo, service, file, symbol, evidence, confidence, status, dropped``: the steps in answers (flow_id, repo, code, answer).

    An answer is an object with ``steps`` or a plain list. ``dropped`` is why an item is no step; null if it is one. ``code`` is what the model was shown.
    """
    item = F.col("item")
    rows = _items(answers, "steps").withColumn("symbol", symbol(text_field(item, "symbol")))
    names = [step_name(text_field(item, f)) for f in ("name", "operation", "description", "label", "action")]
    rows = rows.withColumns({"name": F.coalesce(*names, "symbol"), "file": routes.posix_path(text_field(item, "file"))})
    name = F.col("name")
    dropped = chain([
        (~F.schema_of_variant(item).startswith("OBJECT"), "not an object"), (name.isNull(), "missing meaningful content"),
        (is_abstract(name) & ~is_concrete(name) & ~is_supported(name, F.col("_code")), "suspicious abstract step"),
    ])
    return rows.select(
        "flow_id", (F.col("_at") + 1).cast("long").alias("ord"), flow_kind(text_field(item, "kind")).alias("kind"), "name", F.coalesce(text_field(item, "repo"), "repo").alias("repo"), text_field(item, "service").alias("service"),
        "file", "symbol", _evidence(item, F.col("file")).alias("evidence"), confidence(number_field(item, "confidence")).alias("confidence"), status(text_field(item, "status")).alias("status"), dropped.alias("dropped"),
    )


def told_sinks(answers: DataFrame) -> DataFrame:
    """``flow_id, ord, kind, name, action, repo, service, file, symbol, evidence, confidence, status, dropped``: the sinks in answers."""
    item = F.col("item")
    rows = _items(answers, "sinks").withColumns({"symbol": symbol(text_field(item, "symbol")), "file": routes.posix_path(text_field(item, "file"))})
    rows = rows.withColumn("name", F.coalesce(routes.strip(text_field(item, "name")), "symbol"))
    dropped = chain([(~F.schema_of_variant(item).startswith("OBJECT"), "not an object"), (F.col("name").isNull(), "missing name and symbol")])
    return rows.select(
        "flow_id", (F.col("_at") + 1).cast("long").alias("ord"), sink_kind(F.coalesce(text_field(item, "kind"), F.lit("unknown")), F.col("name")).alias("kind"), "name",
        sink_action(text_field(item, "action")).alias("action"), F.coalesce(text_field(item, "repo"), "repo").alias("repo"), text_field(item, "service").alias("service"), "file", "symbol",
        _evidence(item, F.col("file")).alias("evidence"), confidence(number_field(item, "confidence")).alias("confidence"), status(text_field(item, "status")).alias("status"), dropped.alias("dropped"),
    )


def flow_confidence(answers: DataFrame, steps: DataFrame, sinks: DataFrame) -> DataFrame:
    """``flow_id, confidence``: what an answer says of itself, else the mean over its steps and sinks that have one, else null."""
    said = answers.select("flow_id", F.struct(confidence(number_field(text.json_payload(F.col("answer")), "confidence")).alias("c")).alias("said"), F.lit(None).cast("double").alias("confidence"))
    of = lambda df: df.filter("dropped IS NULL").select("flow_id", F.lit(None).cast("struct<c:double>").alias("said"), "confidence")
    # one shuffle and no join; a flow has as many rows as answers
    every = said.unionByName(of(steps)).unionByName(of(sinks)).groupBy("flow_id").agg(F.collect_list("said").alias("said"), F.avg("confidence").alias("_mean"))
    return every.select("flow_id", "_mean", F.explode("said").alias("s")).select("flow_id", F.coalesce("s.c", "_mean").alias("confidence"))
