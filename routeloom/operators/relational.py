"""Lookups with fallbacks, keyed merges, caps and set operations.

First-seen order is a column, ``ord``; every tie ends in it. Aggregates combine before they shuffle
wherever the semantics allow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions import evidence as ev
from routeloom.functions import routes
from routeloom.functions.kinds import chain, file_role, sink_action, sink_kind
from routeloom.session import cut


def first_per_key(df: DataFrame, keys: Sequence, order: Column) -> DataFrame:
    """The row of least ``order`` for each key; rows combine before the shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(row, order).alias("_row")).select("_row.*")


def top_k(df: DataFrame, by: Sequence, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their ``rank``; groups are cut to ``k`` before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def numbered(rows: DataFrame, whole: Sequence[str], part: str, order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``ord``: 0, 1, 2 … in each ``whole``, by ``part`` and, within it, by ``order``. However rows are split over tasks, the numbers are the same.

    Only numbers of rows are looked at in order over a whole; rows themselves within a part.
    """
    keys = [*whole, part]
    before = Window.partitionBy(*whole).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("_inside", inside).join(bases, keys).withColumn("ord", F.col("_base") + F.col("_inside")).drop("_base", "_inside")


def route_key() -> list[Column]:
    """One key for a route in all its spellings; routes without method or path keep theirs as they are."""
    method, path = F.coalesce(routes.method(F.col("method")), F.lit("")), F.coalesce(routes.path_identity(F.col("path")), F.lit(""))
    partial = (method == "") | (path == "")
    return [
        F.when(partial, F.col("repo")).otherwise(routes.strip(F.col("repo"))).alias("_repo"),
        F.when(partial, F.coalesce("method", F.lit(""))).otherwise(method).alias("_method"),
        F.when(partial, F.coalesce("path", F.lit(""))).otherwise(path).alias("_path"),
    ]


_ROUTE = ("method", "path", "handler", "file", "repo", "service", "confidence", "status", "evidence")


#: Candidates of a route that are looked at in order at once: those of so many values of ``ord``.
BLOCK = 65_536


def _class(status: Column, file: Column) -> Column:
    """0 to 5: deterministic candidates before others, then by the role of the file."""
    role = file_role(file)
    return F.when(status == "deterministic", 0).otherwise(3) + F.when(role == "source_route_candidate", 0).when(role == "unknown", 1).otherwise(2)


def _leaders(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` (key, ord, confidence, _class) with ``_n``, the rows of the key, ``_final``, the confidence that its merge ends with,
    ``_stretch``, the best class so far, and ``_led``: whether a row took the lead when it came.

    A row leads if its class is better than all before, or if it is of the leading class and more confident than the merged row. That one's
    confidence is its leader's, or, where it has none, the first that came along: ``_filled``. There are at most six stretches.
    """
    firsts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *[F.min(F.when(F.col("_class") == k, F.col("ord"))).alias(f"_p{k}") for k in range(6)])
    stretch = chain([(F.coalesce(F.col(f"_p{k}") <= F.col("ord"), F.lit(False)), k) for k in range(6)])
    placed = rows.join(firsts, key).withColumn("_stretch", stretch).drop(*[f"_p{k}" for k in range(6)])

    own = F.col("_class") == F.col("_stretch")
    said = F.col("confidence").isNotNull()
    parts = placed.groupBy(*key, "_stretch").agg(
        F.min(F.struct("ord", "confidence")).alias("first"), F.max(F.when(own, F.col("confidence"))).alias("most"), F.min(F.when(said, F.struct("ord", "confidence", own.alias("own")))).alias("known")
    )
    # the few stretches of a route, from the worst class on: what each starts with, and ends with
    now = F.struct(F.lit(None).cast("double").alias("carry"), F.array().cast("array<struct<_stretch:int,_filled:double>>").alias("out"))
    part = F.struct(F.col("_stretch").alias("k"), F.col("first.confidence").alias("c"), "most", "known")

    def step(acc: Column, x: Column) -> Column:
        late = F.when(~x["known"]["own"], x["known"]["confidence"])
        filled = F.when(x["c"].isNull(), F.coalesce(acc["carry"], late))
        ends = F.greatest(F.coalesce(x["c"], acc["carry"], x["known"]["confidence"]), x["most"])
        return F.struct(ends.alias("carry"), F.concat(acc["out"], F.array(F.struct(x["k"].alias("_stretch"), filled.alias("_filled")))).alias("out"))

    folded = parts.groupBy(*key).agg(F.reverse(F.array_sort(F.collect_list(part))).alias("parts")).select(*key, F.aggregate("parts", now, step).alias("f"))
    fills = folded.select(*key, F.col("f.carry").alias("_final"), F.explode("f.out").alias("x")).select(*key, "_final", "x.*")

    where = [*key, "_stretch"]
    blocked = placed.join(fills, where).withColumn("_block", F.floor(F.col("ord") / BLOCK))
    own_confidence = F.when(own, F.col("confidence"))
    earlier = Window.partitionBy(*where).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy(*where, "_block").agg(F.max(own_confidence).alias("_most"), F.min("ord").alias("_least")).select(
        *where, "_block", F.max("_most").over(earlier).alias("_before"), F.min("_least").over(Window.partitionBy(*where).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)).alias("_start")
    )
    inside = Window.partitionBy(*where, "_block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    most = F.greatest(F.max(own_confidence).over(inside), F.col("_before"), F.col("_filled"))
    beats = own & said & F.coalesce(F.col("confidence") > most, F.lit(True))
    return blocked.join(blocks, [*where, "_block"]).withColumn("_led", (F.col("ord") == F.col("_start")) | beats).drop("_block", "_before", "_start", "_filled")


def merge_routes(candidates: DataFrame) -> DataFrame:
    """One row per route of ``candidates`` (ord, method, path, handler, file, repo, service, confidence, status, evidence); ``ord`` is unique in a repository.

    A left fold in order of ``ord``: of two candidates the deterministic one wins, then that of the better file role, then the more
    confident one, then the earlier; the winner takes the loser's service, confidence and status where it has none, never its handler, and
    the evidence of both, its own first, declarations alone if there are any. Priorities are those of the merged row at each step.

    The fold is not run: who leads at each step follows from running extremes, and all the rest from who led. A status that is filled in never
    changes a priority, for a deterministic candidate is never the loser of another kind. Aggregates combine before they shuffle, and
    what must be looked at in order is cut into blocks of ``ord``, so a route may have any number of candidates.
    """
    key = ["_repo", "_method", "_path"]
    repo, method, path = route_key()
    rows = candidates.select(F.coalesce(repo, F.lit("")).alias("_repo"), method, path, "ord", *_ROUTE, _class(F.col("status"), F.col("file")).alias("_class"))
    led = _leaders(rows.drop("evidence"), key)
    last = lambda c: F.max_by(c, F.when(F.col("_led") & F.col(c).isNotNull(), F.col("ord")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    winner = F.max_by(F.struct("ord", "method", "path", "handler", "file", "repo"), F.when(F.col("_led"), F.col("ord")))
    merged = led.groupBy(*key).agg(
        winner.alias("w"), F.count(F.lit(1)).alias("n"), F.first("_final").alias("confidence"), *[F.coalesce(last(c), first(c)).alias(c) for c in ("service", "status")]
    )

    # leaders push their evidence to the front, the latest first; the others append theirs
    place = F.struct(~F.col("_led"), F.when(F.col("_led"), -F.col("ord")).otherwise(F.col("ord")), "pos")
    pieces = rows.select(*key, "ord", F.posexplode("evidence").alias("pos", "e")).join(led.select(*key, "ord", "_led", "_n"), [*key, "ord"])
    same = [F.col("e.file").alias("_f"), *[F.coalesce(F.col("e")[k], F.lit("")).alias(f"_{k}") for k in ("symbol", "label", "snippet")]]
    single = F.when(F.col("_n") == 1, F.col("pos")).alias("_single")  # a candidate that meets no other keeps its evidence as it is
    distinct = pieces.groupBy(*key, *same, single).agg(F.min(F.struct(place.alias("at"), "e")).alias("p"))
    gathered = distinct.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["e"]).alias("evidence"))
    kept = F.when(F.col("n") == 1, F.col("evidence")).otherwise(ev.prefer_declarations(F.col("evidence")))
    return merged.join(gathered, key, "left").select(
        routes.method(F.col("w.method")).alias("method"), routes.path_identity(F.col("w.path")).alias("path"), "w.handler", "w.file", "w.repo", "service", "confidence", "status",
        F.coalesce(kept, F.array().cast(ev.EVIDENCE)).alias("evidence"),
    )


def merge_planned(routes_df: DataFrame) -> DataFrame:
    """One row per repo, method and path identity of routes (ord, repo, method, path, handler, status, …): the first that a plan gave, else the first with a handler, else the first."""
    planned = F.coalesce(F.col("status").startswith("deterministic_plan"), F.lit(False))
    order = F.struct((~planned).alias("a"), (~planned & F.col("handler").isNull()).alias("b"), F.col("ord"))
    key = ["repo", F.upper(F.coalesce("method", F.lit(""))).alias("_m"), F.coalesce(routes.path_identity(F.col("path")), F.lit("")).alias("_p")]
    return first_per_key(routes_df, key, order)


def dedupe_endpoints(endpoints: DataFrame) -> DataFrame:
    """One row per repo, file, method, path identity and handler: first non-null fields, greatest confidence, all evidence in order.

    Endpoints without any of method, path and handler are told apart by the symbols of their evidence.
    """
    method, path, handler = F.coalesce(routes.method(F.col("method")), F.lit("")), F.coalesce(routes.path_identity(F.col("path")), F.lit("")), F.coalesce("handler", F.lit(""))
    bare = (method == "") & (path == "") & (handler == "")
    symbols = F.array_join(F.array_sort(F.array_distinct(F.filter(F.col("evidence")["symbol"], lambda s: s.isNotNull() & (s != "")))), "|")
    told = F.when(bare, F.coalesce(F.nullif(symbols, F.lit("")), F.lit("__unresolved__"))).otherwise(handler)
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("ord"))).alias(c)
    return endpoints.groupBy("repo", "file", method.alias("_m"), path.alias("_p"), told.alias("_h")).agg(
        F.min("ord").alias("ord"), *[first(c) for c in ("method", "path", "handler", "service", "status")],
        F.max("confidence").alias("confidence"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "evidence"))), lambda x: x["evidence"])).alias("evidence"),
    ).drop("_m", "_p", "_h")


def match_target(endpoints: DataFrame, path: str, method: str | None = None) -> DataFrame:
    """Endpoints that a request for ``path`` may mean, best first by ``rank``; rank 1 is selected, the others are alternatives.

    A path matches as it is written. Endpoints of the wanted method count if there are any, else all of the path
    (``fell_back``). Null confidence ranks as 0, ties by ``ord``. ``match_confidence`` of the selection: its own, else 0.85 if it is alone, else 0.6.
    """
    want = (path.strip().rstrip("/") if path.strip() != "/" else "/") if path.strip().endswith("/") and not path.strip().endswith("//") else path.strip()
    want = want if want.startswith("/") else f"/{want}"
    hits = endpoints.filter(routes.path(F.col("path")) == want)
    every = Window.partitionBy()
    if method and method.strip():
        hit = F.coalesce(routes.method(F.col("method")) == method.strip().upper(), F.lit(False))
        hits = hits.withColumn("_hit", hit).withColumn("_any", F.max("_hit").over(every)).filter("_hit OR NOT _any").withColumn("fell_back", ~F.col("_any"))
    else:
        hits = hits.withColumn("_hit", F.lit(True)).withColumn("_any", F.lit(True)).withColumn("fell_back", F.lit(False))
    order = every.orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "ord")
    alone = F.count(F.lit(1)).over(every) == 1
    return hits.withColumns(
        {"rank": F.row_number().over(order), "match_confidence": F.coalesce("confidence", F.when(alone, 0.85).otherwise(0.6))}
    ).drop("_hit", "_any")


def _call_forms_of(method: str, path: str, service: str) -> list[Column]:
    return [routes.call_verb(F.col(method)).alias("call_method"), routes.api_path(F.col(path)).alias("call_path"), routes.service(F.col(service)).alias("call_service")]


_SPELLED = ("method", "path", "service")


def _spellings(endpoints: DataFrame) -> DataFrame:
    """Each spelling of a method, path and service of ``endpoints``, with the number ``n`` of its rows, and its forms.

    Forms hang on ``n``, so that conditions on them are not moved down to the rows, where each row would be read again for each condition.
    """
    once = lambda form: F.when(F.col("n") > 0, form)
    forms = [once(routes.call_verb(F.col("method"))).alias("_method"), once(routes.api_path(F.col("path"))).alias("_path"), once(routes.service(F.col("service"))).alias("_service")]
    return endpoints.groupBy(*_SPELLED).agg(F.count(F.lit(1)).alias("n")).select(*[F.col(c).alias(f"_{c}_") for c in _SPELLED], *forms, "n")


def _endpoint_forms(endpoints: DataFrame) -> DataFrame:
    """``endpoints`` with the forms that are compared and their ids; each spelling is read once."""
    read = _spellings(endpoints).drop("n")
    ident = F.concat_ws(":", F.coalesce("repo", F.lit("")), F.coalesce("file", F.lit("")), F.coalesce("_method", F.lit("ANY")), F.coalesce("_path", F.lit("?")))
    return endpoints.join(read, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in _SPELLED]).select(
        F.col("ord").alias("target_ord"), "repo", "file", F.col("confidence").alias("endpoint_confidence"), "_method", "_path", "_service", ident.alias("target_id")
    )


def _link_type(found: Column) -> Column:
    return F.when(~found, F.lit(None)).when(F.col("_any"), "exact_method_path").otherwise("path_only")


_LEVELS = (("_path", "_method", "_service"), ("_path", "_method"), ("_path", "_service"), ("_path",))
_CALLED = {"_path": "call_path", "_method": "call_method", "_service": "call_service"}
_KEYS = ("_level", *[f"_k{k}" for k in _CALLED])


def _level_key(n: int, named: dict[str, str]) -> Column:
    """What is looked up at a level: a part that the level leaves open is blank."""
    return F.struct(F.lit(n).alias("_level"), *[(F.coalesce(F.col(c), F.lit("")) if k in _LEVELS[n] else F.lit("")).alias(f"_k{k}") for k, c in named.items()])


def _met(calls: DataFrame, known: list[DataFrame]) -> DataFrame:
    """Each spelling of a method, path and service of ``calls``, read and looked up once: its forms, the number of its calls ``_asked``, and ``_f``.

    ``_f``: of what is known of the keys of each level, in ``known`` (the key, ``_found``), the first that the spelling meets, and its ``level``.
    """
    found = []
    asked = calls.groupBy(*_SPELLED).agg(F.count(F.lit(1)).alias("_asked")).select(*[F.col(c).alias(f"_{c}_") for c in _SPELLED], *_call_forms_of(*_SPELLED), "_asked")
    for n, (key, at) in enumerate(zip(_LEVELS, known, strict=True)):
        own = at.select(*[F.col(k).alias(f"{k}{n}") for k in key], F.col("_found").withField("level", F.lit(n)).alias(f"_found{n}"))
        asked = asked.join(own, [F.col(_CALLED[k]) == F.col(f"{k}{n}") for k in key], "left").drop(*[f"{k}{n}" for k in key])
        found.append(F.col(f"_found{n}"))
    return asked.select(*[f"_{c}_" for c in _SPELLED], *_CALLED.values(), "_asked", F.coalesce(*found).alias("_f"))


def _each_call(calls: DataFrame, met: DataFrame) -> DataFrame:
    """``calls`` with what their spellings have in ``met``."""
    rows = calls.select("call_id", F.col("confidence").alias("call_confidence"), *_SPELLED)
    return rows.join(met.drop("_asked"), [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in _SPELLED], "left").drop(*_SPELLED, *[f"_{c}_" for c in _SPELLED])


def _decided(calls: DataFrame, known: list[DataFrame]) -> DataFrame:
    """Forms of ``calls`` with ``_f``, as :func:`_met` finds it."""
    return _each_call(calls, _met(calls, known))


def _counted(endpoints: DataFrame) -> list[DataFrame]:
    """For each level the number of ``endpoints`` (method, path, service) of its keys; each spelling is read once, and levels are summed up from the finest."""
    e = _spellings(endpoints).groupBy(*_CALLED).agg(F.sum("n").alias("n")).filter("_path IS NOT NULL")
    return [e.dropna(subset=list(key)).groupBy(*key).agg(F.sum("n").alias("n")).select(*key, F.struct("n").alias("_found")) for key in _LEVELS]


def _under_keys(endpoints: DataFrame, *columns: str) -> DataFrame:
    """Every endpoint with a path, under each of its keys."""
    complete = lambda key: F.when(F.greatest(*[F.col(k).isNull() for k in key], F.lit(False)), F.lit(None))
    keys = F.array(*[complete(key).otherwise(_level_key(n, {k: k for k in _CALLED})) for n, key in enumerate(_LEVELS)])
    return endpoints.filter("_path IS NOT NULL").select(*columns, F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("k")).select(*columns, "k.*")


def _asking(decided: DataFrame) -> DataFrame:
    """Decided calls with the one key that decided them."""
    return decided.withColumn("k", chain([(F.col("_f.level") == n, _level_key(n, _CALLED)) for n in range(len(_LEVELS))])).select("*", "k.*").drop("k")


def count_endpoints(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Each call with ``link_type`` and ``matches``, the number of endpoints that :func:`lookup_endpoints` finds for it; no call meets an endpoint."""
    decided = _decided(calls, _counted(endpoints)).withColumn("_any", F.col("_f.level") <= 1)
    return decided.withColumns({"link_type": _link_type(F.col("_f").isNotNull()), "matches": F.coalesce("_f.n", F.lit(0).cast("long"))}).drop("_f", "_any")


def lookup_endpoints(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Each call with the endpoints it may reach, by tiers; a call without any keeps one row of nulls.

    ``calls``: call_id, method, path, service, confidence. ``endpoints``: ord, repo, file, method, path, service, confidence.
    Method and path together count first, path alone second; a service narrows its tier only if some row of it has that service.
    Lookups decide the tier, and a call meets the endpoints of that tier alone.
    """
    e = _endpoint_forms(endpoints)
    decided = _asking(_decided(calls, _counted(endpoints))).withColumn("_any", F.col("_f.level") <= 1).drop("_f")
    hits = decided.join(_under_keys(e, *e.columns), list(_KEYS), "left").drop(*_KEYS)
    return hits.withColumn("link_type", _link_type(F.col("target_id").isNotNull()))


def link_confidence(call: Column, endpoint: Column, matched: Column) -> Column:
    clamp = lambda x, top: F.least(F.lit(top), F.greatest(F.lit(0.0), x))
    # a confidence of 0 counts as none, as it does where it comes from
    or_default = lambda x: F.when(x.isNull() | (x == 0), F.lit(0.45)).otherwise(x)
    alone = F.when(call.isNotNull(), clamp(call * 0.8, 0.8))
    return F.when(~matched, alone).when(call.isNotNull() | endpoint.isNotNull(), clamp((or_default(call) + or_default(endpoint)) / 2, 0.95))


def link_calls(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Links of calls: one to the only or the clearly stronger endpoint, else to every endpoint, marked ``ambiguous``.

    One endpoint is clearly stronger if it and the second have a confidence and differ by 0.2 or more.

    What a call may reach is all endpoints of its path, method and service; else of its path and method; else of its path and service, or of
    its path. For each of these keys the number of endpoints and the two strongest are known, so a call is decided by four lookups. Only
    ambiguous calls meet endpoints themselves, and each such pair is a link.
    """
    # the two strongest of a spelling, read as forms, are all that the two strongest of a key may come from
    order = lambda confidence, ord_, *between: [F.coalesce(confidence, F.lit(-1.0)).desc(), F.col("repo").desc(), F.col("file").desc(), *between, F.col(ord_)]
    strong = _endpoint_forms(top_k(endpoints, _SPELLED, order("confidence", "ord"), 2)).filter("_path IS NOT NULL")
    known = []
    for key, counted in zip(_LEVELS, _counted(endpoints), strict=True):
        first = top_k(strong.dropna(subset=list(key)), key, order("endpoint_confidence", "target_ord", F.coalesce("_method", F.lit("")).desc()), 2)
        best = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "target_id", "endpoint_confidence"))).alias("best"))
        known.append(counted.join(best, list(key)).select(*key, F.col("_found").withField("best", F.col("best")).alias("_found")))
    met = _met(calls, known).withColumns({
        "matches": F.coalesce("_f.n", F.lit(0).cast("long")), "_any": F.col("_f.level") <= 1, "_first": F.try_element_at("_f.best", F.lit(1)), "_next": F.try_element_at("_f.best", F.lit(2)),
    })
    lead = F.coalesce(F.col("_first.endpoint_confidence") - F.col("_next.endpoint_confidence") >= 0.2, F.lit(False))
    # looked at several times; uncut, the lookups would be planned again each time
    met = cut(met.withColumn("_one", (F.col("matches") <= 1) | lead).withColumn("_f", F.struct("_f.level")).drop("_next"))
    decided = _each_call(calls, met)
    shown = lambda df, target, strength: df.select(
        "call_id", target.alias("target_id"), _link_type(target.isNotNull()).alias("link_type"), F.col("call_method").alias("method"), F.col("call_path").alias("path"), "matches", (~F.col("_one")).alias("ambiguous"),
        link_confidence(F.col("call_confidence"), strength, target.isNotNull()).alias("confidence"),
    )
    # a call asks for the one key that decided it
    several = _asking(decided.filter("NOT _one")).select("call_id", "call_method", "call_path", "call_confidence", "matches", "_any", "_one", *_KEYS)
    asked = _asking(met.filter("NOT _one")).groupBy(*_KEYS).agg(F.sum("_asked").alias("_asked"), F.first("matches").alias("_matches"))
    pairs = _in_tiles(several, ["call_id", "call_confidence"], asked, _under_keys(_endpoint_forms(endpoints), "target_ord", "target_id", "endpoint_confidence"), "target_ord")
    return shown(decided.filter("_one"), F.col("_first.target_id"), F.col("_first.endpoint_confidence")).unionByName(shown(pairs, F.col("target_id"), F.col("endpoint_confidence")))


#: Rows of a tile of a join whose pairs are its result: of the side that is streamed out of arrays, and of the one that is held against them.
STREAMED, HELD = 1 << 12, 1 << 12


def _in_tiles(asking: DataFrame, own: Sequence[str], asked: DataFrame, held: DataFrame, other: str) -> DataFrame:
    """``asking`` with each row of ``held`` of its key; the same pairs as of a plain join. ``asked``: each key with the numbers of its rows on either side, ``_asked`` and ``_matches``.

    A key's rows on either side are cut into tiles by the hash of the first of ``own`` and of ``other``, and each tile meets each of the other side
    once: many units of work, at most STREAMED x HELD pairs each or so, that are dealt out over all tasks. Rows of ``asking`` that differ in ``own``
    alone are one array in their tile, so the join makes a row for an array and not for a pair, and the array becomes rows as the last step.
    """
    cut = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    sizes = asked.select(*_KEYS, cut("_asked", STREAMED).alias("_is"), cut("_matches", HELD).alias("_js"))
    tile = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    same = [c for c in asking.columns if c not in own]
    left = asking.join(sizes, list(_KEYS)).withColumn("_i", tile(own[0], "_is")).groupBy(*same, "_i", "_js").agg(F.collect_list(F.struct(*own)).alias("_packed"))
    left = left.withColumn("_j", each("_js")).drop("_js")
    right = held.join(sizes, list(_KEYS)).withColumn("_j", tile(other, "_js")).withColumn("_i", each("_is")).drop("_is", "_js", other)
    spark, unit = asking.sparkSession, [*_KEYS, "_i", "_j"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    # a number of partitions that is said is kept: few bytes may stand for many pairs
    met = right.repartition(tasks, *unit).join(left.repartition(tasks, *unit).hint("merge"), unit)
    return met.select(*[c for c in met.columns if c not in (*unit, "_packed")], F.inline("_packed"))


def dedupe_calls(calls: DataFrame) -> DataFrame:
    """One row per source, method, path and service: first text, greatest confidence, and, where ``calls`` has evidence, all of it in order, each piece once."""
    key = ["source_repo", "source_file", "method", "path", "service"]
    empty = lambda c: F.coalesce(c, F.lit(""))
    rows = calls.select(
        "source_repo", empty(F.col("source_file")).alias("source_file"), empty(routes.call_verb(F.col("method"))).alias("method"), empty(routes.api_path(F.col("path"))).alias("path"),
        empty(routes.service(F.col("service"))).alias("service"), "ord", "raw_text", "confidence", *[c for c in ("evidence",) if c in calls.columns],
    )
    text = F.min_by("raw_text", F.when(empty(F.col("raw_text")) != "", F.col("ord")))
    out = rows.groupBy(*key).agg(F.min("ord").alias("ord"), text.alias("raw_text"), F.max("confidence").alias("confidence"))
    if "evidence" not in calls.columns:
        return out
    pieces = rows.select(*key, "ord", F.posexplode("evidence").alias("pos", "e")).groupBy(*key, "e").agg(F.min(F.struct("ord", "pos")).alias("at"))
    gathered = pieces.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "e"))), lambda p: p["e"]).alias("evidence"))
    match = [out[k].eqNullSafe(gathered[k]) for k in key]
    return out.join(gathered, match, "left").select(*[out[c] for c in out.columns], F.coalesce(gathered["evidence"], F.array().cast(ev.EVIDENCE)).alias("evidence"))


def merge_sinks(explicit: DataFrame, derived: DataFrame) -> DataFrame:
    """Explicit sinks, all of them, and derived ones of a kind, action, file and repo that no explicit sink has.

    Both: flow_id, ord, kind, name, action, file, repo, status. A derived sink that is not inferred takes the place of an inferred one.
    """
    own = lambda df, n: df.select(
        "flow_id", "ord", sink_kind(F.col("kind"), F.col("name")).alias("kind"), "name", sink_action(F.col("action")).alias("action"), "file", "repo", "status", F.lit(n).alias("_src")
    )
    key = [F.col("flow_id"), F.col("kind"), *[F.coalesce(c, F.lit("")).alias(f"_{c}") for c in ("action", "file", "repo")]]
    said, found = own(explicit, 0), own(derived, 1)
    at = said.unionByName(found)
    # of the rows of a key: the last explicit one stands for it; else the first derived one; then the first better derived one
    better = F.min(F.when((F.col("_src") == 1) & (F.coalesce("status", F.lit("")) != "inferred"), F.struct("ord", "name", "status")))
    holder = F.coalesce(F.max(F.when(F.col("_src") == 0, F.struct(F.col("ord"), F.coalesce("status", F.lit("")).alias("status")))), F.min(F.when(F.col("_src") == 1, F.struct(F.col("ord"), F.coalesce("status", F.lit("")).alias("status")))))
    states = at.groupBy(*key).agg(holder.alias("_holder"), better.alias("_better"), F.min("_src").alias("_first"))
    keyed = at.select("*", *[F.coalesce(c, F.lit("")).alias(f"_{c}") for c in ("action", "file", "repo")])
    rows = keyed.join(states, ["flow_id", "kind", "_action", "_file", "_repo"])
    replaced = (F.col("_holder.status") == "inferred") & F.col("_better").isNotNull()
    stands = (F.col("ord") == F.col("_holder.ord")) & (F.col("_src") == F.col("_first"))
    swap = lambda c: F.when(stands & replaced, F.col(f"_better.{c}")).otherwise(F.col(c)).alias(c)
    return rows.filter((F.col("_src") == 0) | stands).select(
        "flow_id", (F.col("_src") * 1_000_000 + F.col("ord")).alias("ord"), "kind", swap("name"), "action", "file", "repo", swap("status")
    )


def cap_with_quota(df: DataFrame, by: Sequence[str], cap: Column, classes: Sequence[Column], quality: Column) -> DataFrame:
    """At most ``cap`` rows of each group: the first row of every class, then the best by quality, ties by ``ord``; in original order."""
    group = Window.partitionBy(*by)
    marks = {f"_class{i}": F.coalesce(c, F.lit(False)) for i, c in enumerate(classes)}
    rows = df.withColumns({**marks, "_quality": quality, "_cap": cap, "_n": F.count(F.lit(1)).over(group)})
    for i in range(len(classes)):
        rows = rows.withColumn(f"_first{i}", F.min(F.when(F.col(f"_class{i}"), F.col("ord"))).over(group))
    reserved = F.coalesce(chain([(F.col("ord") == F.col(f"_first{i}"), True) for i in range(len(classes))], False), F.lit(False))
    order = group.orderBy(F.col("_reserved").desc(), F.col("_quality").desc(), "ord")
    rows = rows.withColumn("_reserved", reserved).withColumn("_rank", F.row_number().over(order))
    return rows.filter("_n <= _cap OR _reserved OR _rank <= _cap").select(*df.columns)


def best_under_both_keys(df: DataFrame, by: Sequence[str], first_key: Column, second_key: Column, quality: Column) -> DataFrame:
    """Rows that are the best of their first key and of their second; ties by ``ord``."""
    order = [quality.desc(), F.col("ord")]
    rows = df.withColumns({
        "_a": F.row_number().over(Window.partitionBy(*by, first_key).orderBy(*order)),
        "_b": F.row_number().over(Window.partitionBy(*by, second_key).orderBy(*order)),
    })
    return rows.filter("_a = 1 AND _b = 1").select(*df.columns)


def suppress_generic(df: DataFrame, by: Sequence[str], generic: Column, specific: Column) -> DataFrame:
    """Without the generic rows of groups that have a specific one."""
    has = F.max(F.coalesce(specific, F.lit(False))).over(Window.partitionBy(*by))
    return df.withColumn("_has", has).filter(~(F.coalesce(generic, F.lit(False)) & F.col("_has"))).drop("_has")


def snapshot_diff(cached: DataFrame, current: DataFrame) -> DataFrame:
    """``repo, path, change``: added, removed or changed files of two snapshots (repo, path, mtime, size, sha).

    A file whose time or size differs is unchanged all the same if its digest agrees.
    """
    old = cached.select("repo", "path", *[F.col(c).alias(f"_{c}") for c in ("mtime", "size", "sha")], F.lit(True).alias("_old"))
    both = current.withColumn("_new", F.lit(True)).join(old, ["repo", "path"], "full_outer")
    moved = (F.col("mtime") != F.col("_mtime")) | (F.col("size") != F.col("_size"))
    change = chain(
        [(F.col("_old").isNull(), "added"), (F.col("_new").isNull(), "removed"), (moved & ~F.coalesce(F.col("sha") == F.col("_sha"), F.lit(False)), "changed")]
    )
    return both.select("repo", "path", change.alias("change")).filter("change IS NOT NULL")


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with ``rows`` in place of those of the same keys."""
    return table.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows)


def within_directories(files: DataFrame, directories: DataFrame, path: str = "path") -> DataFrame:
    """Files in one of ``directories`` (dir) or below; all files if there are no directories.

    A file's ancestors are its keys, so this is an equi-join, not a prefix search.
    """
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    keyed = files.withColumn("_id", F.monotonically_increasing_id()).withColumn("_dir", F.explode(above))
    found = keyed.join(directories.select(F.col("dir").alias("_dir")).distinct(), "_dir", "left_semi").drop("_dir").dropDuplicates(["_id"]).drop("_id")
    return files if directories.isEmpty() else found
