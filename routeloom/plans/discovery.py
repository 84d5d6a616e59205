"""Discovery of routes from files: extraction, mounts, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.extract import tables
from routeloom.functions import evidence as ev
from routeloom.functions import routes
from routeloom.operators import graph, relational
from routeloom.session import cut

SCRIPT_SUFFIXES = (".ts", ".tsx", ".js", ".jsx")


def import_targets(imports: DataFrame, *more: str) -> DataFrame:
    """``repo, file, name, target, priority`` and ``more``: files that an import may mean, best first: as named, or with each suffix, or its index file."""
    folder = F.regexp_replace("file", "[^/]*$", "")
    raw = F.concat(folder, "path")
    for _ in range(4):  # up to four steps up
        raw = F.regexp_replace(F.regexp_replace(raw, r"(^|/)\./", "$1"), r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    named = F.regexp_extract(raw, r"[^/.](\.[^/.]+)$", 1) != ""
    options = F.when(named, F.array(raw)).otherwise(F.array(*[F.concat(raw, F.lit(s)) for s in SCRIPT_SUFFIXES], *[F.concat(raw, F.lit(f"/index{s}")) for s in SCRIPT_SUFFIXES]))
    return imports.select("repo", "file", "name", *more, F.posexplode(options).alias("priority", "target"))


def _resolve(uses: DataFrame, routers: DataFrame, defaults: DataFrame, imports: DataFrame) -> DataFrame:
    """``uses`` (repo, file, symbol) with ``container``: a router of the same file, else what the symbol's import leads to; else null.

    Only imports of symbols that are used get their targets, eight for each.
    """
    keys = uses.select("repo", "file", "symbol").distinct()
    own = keys.join(routers.select("repo", "file", "symbol"), ["repo", "file", "symbol"], "left_semi").select("*", F.concat_ws("::", "file", "symbol").alias("container"), F.lit(-1).alias("priority"))
    used = imports.join(keys.withColumnRenamed("symbol", "name"), ["repo", "file", "name"], "left_semi")
    far = import_targets(used).withColumnRenamed("name", "symbol")
    by_default = far.join(defaults.select("repo", F.col("file").alias("target"), F.col("symbol").alias("exported")), ["repo", "target"]).withColumn("wanted", F.col("exported")).drop("exported")
    either = by_default.withColumn("priority", F.col("priority") * 2).unionByName(far.select("repo", "target", "file", "symbol", (F.col("priority") * 2 + 1).alias("priority"), F.col("symbol").alias("wanted")))
    there = routers.select("repo", F.col("file").alias("target"), F.col("symbol").alias("wanted"))
    found = either.join(there, ["repo", "target", "wanted"]).select("repo", "file", "symbol", F.concat_ws("::", "target", "wanted").alias("container"), "priority")
    best = own.unionByName(found).groupBy("repo", "file", "symbol").agg(F.min_by("container", "priority").alias("container"))
    return uses.join(best, ["repo", "file", "symbol"], "left")


def router_graph(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declarations and mounts that a relation of facts describes, as :func:`routeloom.operators.graph.compose_routes` takes them.

    Receivers that are no known router stand for routers of their own file. Mounts of a child that resolves nowhere keep a null child.
    """
    of = lambda kind: facts.filter(F.col("kind") == kind)
    routers = of("router").select("repo", "file", F.col("name").alias("symbol")).distinct()
    defaults = of("export").filter("method = 'default'").groupBy("repo", "file").agg(F.max_by("name", "line").alias("symbol"))
    imports = of("import")
    scoped = lambda c: F.concat_ws("|", "repo", c)
    declared = _resolve(of("route_call").withColumnRenamed("receiver", "symbol"), routers, defaults, imports).select(
        F.xxhash64("repo", "file", "line", "pos").alias("decl_id"), "repo", "file", "line", "pos", F.col("name").alias("handler"), "snippet", "method", "path",
        scoped(F.coalesce("container", F.concat_ws("::", "file", "symbol"))).alias("container"),
    )
    calls = of("mount_call")
    parents = _resolve(calls.withColumnRenamed("receiver", "symbol"), routers, defaults, imports).select(
        "repo", "file", "line", "pos", "path", F.col("name").alias("symbol"), "snippet", scoped(F.coalesce("container", F.concat_ws("::", "file", "symbol"))).alias("parent")
    )
    mounts = _resolve(parents, routers, defaults, imports).select(
        F.xxhash64("repo", "file", "line", "pos").alias("mount_id"), "parent", F.when(F.col("container").isNotNull(), scoped("container")).alias("child"), F.col("path").alias("prefix"), "file", "line", "symbol", "snippet"
    )
    return declared, mounts


def discover(files: DataFrame) -> DataFrame:
    """Routes of repositories (repo, path, text): declared ones and those composed from mounts, merged, low-quality ones dropped."""
    declared = tables.declared_routes(files).withColumn("_way", F.array().cast("array<bigint>")).drop("framework")
    facts = tables.route_facts(files).filter("kind <> 'literal'")  # nothing is composed of literals
    declarations, mounts = map(cut, router_graph(cut(facts)))
    composed = graph.compose_routes(declarations, mounts).join(declarations.select("decl_id", "repo", "file", "line", "pos", "handler", "snippet"), "decl_id")
    rows = composed.select(
        "pos", "line", F.col("chain").alias("_way"), "method", F.col("full_path").alias("path"), "handler", "file", "repo", F.lit(None).cast("string").alias("service"),
        F.lit(0.9).alias("confidence"), F.lit("deterministic_composed").alias("status"),
        F.array(F.struct("file", F.col("handler").alias("symbol"), F.lit("route_declaration").alias("label"), "snippet")).alias("evidence"),
    )
    every = declared.unionByName(rows)
    cols = [F.col(c) for c in ("file", "repo", "method", "path", "handler", "confidence", "evidence")]
    # the merge looks at its candidates several times; files are parsed once
    good = cut(every.withColumn("_why", ev.reject_reason(*cols)).filter("_why IS NULL").drop("_why"))
    # declared routes come before composed ones, each by file and place
    stage = F.concat_ws(":", F.when(F.col("status") == "deterministic", "0").otherwise("1"), "file")
    placed = relational.numbered(good.withColumn("_part", stage), ["repo"], "_part", [F.col("line"), F.col("pos"), F.col("path"), F.col("_way")])
    return relational.merge_routes(placed.drop("line", "pos", "_way", "_part"))


def resolve_handlers(endpoints: DataFrame, symbols: DataFrame, imports: DataFrame, *, break_ties: bool = False) -> DataFrame:
    """``repo, file, handler, status, target_file, start_line, candidates``: where handlers are implemented.

    In this order: a function of the same file; what the import of the handler's first part leads to; the only symbol of that
    name in the repository. Several are ``ambiguous``, none is ``unresolved``. ``break_ties``, for names that are called: of several, the only
    function, the only exported one, the only one outside of test folders, the first of these for a transfer of files, or the only exported symbol.
    """
    wanted = endpoints.select("repo", "file", "handler").filter("handler IS NOT NULL").distinct()
    key = ["repo", "_tier", "_place", "_name"]
    under = lambda tier, place, name: F.struct(F.lit(tier).alias("_tier"), place.alias("_place"), name.alias("_name"))
    at, nowhere, dotted = F.col("target_file"), F.lit(""), lambda c: F.col(c).contains(".")
    s = symbols.select("repo", F.col("path").alias("target_file"), "name", "qualified_name", "kind", "start_line", F.col("export_kind").isNotNull().alias("exported"))
    # a symbol under each of its keys, and for each key what its symbols come to: a name of many symbols meets many handlers as one row
    keys = F.array(
        F.when(F.col("kind") == "function", under(0, at, F.col("name"))),
        F.when(F.col("kind").isin("function", "class") & ~dotted("name"), under(1, at, F.col("name"))), F.when(dotted("qualified_name"), under(1, at, F.col("qualified_name"))),
        under(2, nowhere, F.col("name")), F.when(~F.col("qualified_name").eqNullSafe(F.col("name")), under(2, nowhere, F.col("qualified_name"))),
    )
    keyed = s.select("repo", "target_file", "start_line", "kind", "exported", F.explode(F.filter(keys, lambda k: k["_name"].isNotNull())).alias("k"))
    place = F.struct("target_file", "start_line")
    function, outside = F.col("kind") == "function", ~F.concat(F.lit("/"), "target_file").contains("/tests/")
    ties = {"fn": function, "shared": function & F.col("exported"), "outside": function & outside, "public": F.col("exported")}
    known = keyed.select("repo", "k.*", "target_file", "start_line", "kind", "exported").repartition(*key).distinct().groupBy(*key).agg(
        F.count(F.lit(1)).alias("candidates"), F.min(place).alias("t"), *[x for n, c in ties.items() for x in (F.count_if(c).alias(f"_n_{n}"), F.min(F.when(c, place)).alias(f"_{n}"))],
    )
    asked = wanted.select("*", F.explode(F.array(under(0, F.col("file"), F.col("handler")), under(2, nowhere, F.col("handler")))).alias("k")).select("repo", "file", "handler", "k._tier", "k._place", "k._name")
    root = F.substring_index("handler", ".", 1)
    # neither side is broadcast: by their plans a few bytes of a table become texts and rows of them, so all sizes are guessed too small
    far = import_targets(wanted.withColumn("name", root).join(imports.select("repo", "file", "name", "path").hint("merge"), ["repo", "file", "name"]), "handler").select(
        "repo", "file", "handler", F.lit(1).alias("_tier"), F.col("target").alias("_place"), F.col("handler").alias("_name")
    ).distinct()
    stats = {"candidates": F.sum, "t": F.min, **{c: f for n in ties for c, f in ((f"_n_{n}", F.sum), (f"_{n}", F.min))}}
    found = asked.unionByName(far).join(known.hint("merge"), key, "left").groupBy("repo", "file", "handler", "_tier").agg(*[f(c).alias(c) for c, f in stats.items()])
    best = F.min(F.when(F.col("candidates").isNotNull(), F.struct(F.col("_tier").alias("tier"), *stats)))
    out = found.groupBy("repo", "file", "handler").agg(best.alias("b")).select("repo", "file", "handler", "b.*")
    open_ = (F.col("candidates") > 1) & (F.col("tier") == 2)
    if break_ties:
        transfer = F.lower("handler").rlike("^(upload|download|putobject)")
        pick = F.coalesce(*[F.when(F.col(f"_n_{n}") == 1, F.col(f"_{n}")) for n in ("fn", "shared", "outside")], F.when(transfer, F.col("_outside")), F.when(F.col("_n_public") == 1, F.col("_public")))
        out = out.withColumns({"t": F.when(open_, F.coalesce(pick, "t")).otherwise(F.col("t")), "_settled": open_ & pick.isNotNull()})
        open_ = open_ & ~F.col("_settled")
    status = F.when(F.col("candidates").isNull(), "unresolved").when(open_, "ambiguous").otherwise("resolved")
    return out.select("repo", "file", "handler", status.alias("status"), "t.target_file", "t.start_line", F.coalesce("candidates", F.lit(0)).alias("candidates"))
