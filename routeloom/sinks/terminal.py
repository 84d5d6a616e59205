"""Results as lines of text, for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions import text
from routeloom.functions.kinds import any_of, chain

# Notes that are about how a result was made, and notes that are not shown.
DIAGNOSTIC_NOTES = (
    "candidate_files=", "files_sent_to_llm=", "prompt_chars=", "flow expansion context files selected:", "flow expansion prompt chars:", "flow expansion timeout:", "using anchor file:",
    "anchor file appears sufficient", "selected ", "included ", "truncated", "llm timeout", "no nearby related files were selected", "contextual file", "discovery unavailable", "unavailable:",
)
VERBOSE_NOTES = (
    "Flow expansion context files selected:", "Flow expansion prompt chars:", "Flow expansion timeout:", "Selected ", "Included ", "Cross-repo candidate normalized:", "Matched target endpoint:",
    "Raw call text:", "Applied service hint narrowing", "Sink merge result:", "Flow expansion extracted ",
)


def step_label(c: Column) -> Column:
    """A step's name with blanks for underscores, unless it is a dotted one."""
    flat = text.compact(c)
    return F.when(flat.contains("."), flat).otherwise(text.compact(F.replace(flat, F.lit("_"), F.lit(" "))))


def group_title(category: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.initcap(F.trim(F.replace(category, F.lit("_"), F.lit(" ")))))


def note_section(note: Column) -> Column:
    """``artifacts``, ``diagnostics`` or ``evidence``."""
    low = F.lower(note)
    return chain([(low.contains("saved ") & low.contains("artifact"), "artifacts"), (any_of(low, DIAGNOSTIC_NOTES), "diagnostics")], "evidence")


def is_concise(note: Column) -> Column:
    return ~any_of(note, VERBOSE_NOTES)


def step_headline(kind: Column, name: Column, entity: Column) -> Column:
    """A step of a flow in a few words."""
    k, what = F.lower(F.trim(F.coalesce(kind, F.lit("")))), F.coalesce(F.nullif(entity, F.lit("")), name)
    said = lambda head, c: F.concat(F.lit(f"{head}: "), c)
    return chain([
        (k == "dependency", said("dependency", F.regexp_replace(name, r"^Depends\((.*)\)$", "$1"))), (k == "db_read", said("database read", what)), (k == "db_write", said("database write", what)),
        (k == "external_api_call", said("external call", name)), (k == "input_model", said("input model", F.replace(name, F.lit("input model: "), F.lit("")))),
    ], said("step", step_label(name)))


def _lines(rows: DataFrame, order: list) -> list[str]:
    return [r[0] for r in rows.orderBy(*order).select("line").toLocalIterator()]


def route_lines(routes: DataFrame) -> DataFrame:
    """``repo, service, line, …`` of routes (repo, service, method, path, handler, file, confidence, status), a paragraph each, to be ordered by the rest."""
    part = lambda c, head: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"\n      {head}="), c.cast("string"))).otherwise("")
    line = F.concat(
        F.lit("    - "), F.coalesce("method", F.lit("?")), F.lit(" "), F.coalesce("path", F.lit("?")), part(F.col("handler"), "handler"), part(F.col("file"), "file"),
        part(F.format_number("confidence", 2), "confidence"), part(F.col("status"), "status"),
    )
    return routes.select("repo", F.coalesce(F.nullif("service", F.lit("")), F.lit("(unknown-service)")).alias("service"), "method", "path", "file", "handler", line.alias("line"))


def render_routes(routes: DataFrame, repos: list[tuple[str, str]], notes: list[str] = ()) -> str:
    """Routes by repository and service."""
    out = ["Routes", "Repos:", *([f"  - {name}: {root}" for name, root in repos] or ["  - (none)"])]
    rows = route_lines(routes)
    heads = Window.partitionBy("repo", "service").orderBy("method", "path", "file", "handler")
    headed = rows.withColumn("line", F.when(F.row_number().over(heads) == 1, F.concat(F.lit("  "), "repo", F.lit(" / "), "service", F.lit(":\n"), "line")).otherwise(F.col("line")))
    found = _lines(headed, ["repo", "service", "method", "path", "file", "handler"])
    out += [f"Routes discovered: {len(found)}", *(["By repo and service:", *found] if found else ["No routes discovered yet"])]
    return "\n".join([*out, *(["Notes:", *(f"  - {n}" for n in notes)] if notes else [])])


def render_trace(summary: DataFrame, steps: DataFrame, sinks: DataFrame, links: DataFrame, tests: DataFrame | None = None, notes: list[str] = ()) -> str:
    """A trace: its endpoint, steps, sinks, links to other services, each once, and the first two tests of each category."""
    top = summary.first()
    if top is None:
        return "No endpoint matches"
    out = [f"Trace: {top['method'] or 'ANY'} {top['path']}", f"  handler={top['handler'] or '?'} file={top['file']} repo={top['repo']}", f"  confidence={top['confidence']:.2f}"]
    shown = steps.select("ord", F.concat(F.lit("  - "), step_headline(F.col("kind"), F.col("name"), F.lit(None).cast("string"))).alias("line"))
    sections = [("Flow:", shown, ["ord"]), ("Sinks:", sinks.select(F.concat_ws(" ", F.lit("  -"), "kind", "action", "name").alias("line")).distinct(), ["line"])]
    sections.append(("Links:", links.filter("target_id IS NOT NULL").select(F.concat_ws(" ", F.lit("  -"), "method", "path", F.lit("->"), "target_id").alias("line")).distinct(), ["line"]))
    if tests is not None:
        first = tests.withColumn("_n", F.row_number().over(Window.partitionBy("category").orderBy("ord"))).filter("_n <= 2")
        sections.append(("Tests:", first.select("category", "_n", F.concat(F.lit("  - "), group_title(F.col("category"), F.lit(None).cast("string")), F.lit(": "), "name").alias("line")), ["category", "_n"]))
    for head, rows, order in sections:
        found = _lines(rows, order)
        out += [head, *found] if found else []
    return "\n".join([*out, *(["Notes:", *(f"  - {n}" for n in notes if not any(v in n for v in VERBOSE_NOTES))] if notes else [])])
