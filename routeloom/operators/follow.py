"""Following calls from a handler, one hop, within budgets; and the layers that come of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.extract.scan import called_names, is_followable
from routeloom.extract.tables import per_file
from routeloom.functions import kinds
from routeloom.functions.kinds import any_of, chain
from routeloom.operators.scores import importance


@dataclass(frozen=True)
class Budgets:
    """What may be followed for one endpoint."""

    files: int = 10
    functions: int = 20
    steps: int = 40
    calls: int = 8


_STATEMENT = "struct<index:bigint,text:string,signals:array<string>>"


def calls_of(statements: DataFrame) -> DataFrame:
    """Calls in ``statements`` (endpoint_id, file, index, text, signals): ``endpoint_id, file, index, pos, call, followable, importance, skip``."""
    found = per_file(
        statements, lambda t: [{"call": n, "followable": is_followable(n)} for n in called_names(t)], "call string, followable boolean", ("endpoint_id", "file", "index", "signals", "text"), "text"
    )
    return found.select(
        "endpoint_id", "file", "index", "pos", "call", "followable", importance(F.col("call"), F.col("signals")).alias("importance"), skip_reason(F.col("call"), F.col("text")).alias("skip")
    )


def skip_reason(call: Column, text: Column) -> Column:
    """Why a call is not worth following; null if it may be."""
    low, said = F.lower(call), F.lower(text)
    wrappers = ("serverresponse", "apiresponse", "responsedto")
    made = F.regexp_like(text, F.concat(F.lit(r"\bnew\s+\Q"), call, F.lit(r"\E\s*\(")))
    sql = any_of(said, ("insert into", "update ", "delete from", "select ")) & (low.isin("values", "concat") | low.contains("task_attachments"))
    return chain([
        (made & any_of(low, wrappers), "low_value_response_wrapper"), (made, "constructor_wrapper_skipped"), (low.isin(*wrappers), "low_value_response_wrapper"),
        (low.isin("getstorageurl", "getrootdir", "getconfig", "getenv"), "low_value_config_getter"), (low.isin("humanfilesize", "formatdate", "smallid"), "low_value_formatting_helper"),
        (low.isin("getkey", "getavatarkey", "buildpath"), "low_value_key_builder"), (call.rlike("^[A-Z_]+$"), "string_literal_false_positive"), (sql, "string_literal_false_positive"),
    ])


def follow(calls: DataFrame, bodies: DataFrame, primary: DataFrame, budgets: Budgets = Budgets()) -> DataFrame:
    """``endpoint_id, pos, call, outcome, target_file, target, steps``: what becomes of the first calls of each endpoint, most important first.

    ``calls``: as :func:`calls_of` gives them. ``bodies``: endpoint_id, call, target_file, target, statements (null if it has no body), reason (why it did not resolve).
    ``primary``: endpoint_id, file, handler, steps (its own number). ``outcome``: followed, cycle, a skip reason or the reason it did not resolve. An endpoint
    has at most ``budgets.calls`` such rows, so the budgets, which depend on what was accepted before, are a fold within one row.
    """
    order = Window.partitionBy("endpoint_id").orderBy(F.desc("importance"), "index", "pos")
    first = calls.filter("followable").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= budgets.calls)
    rows = first.join(bodies, ["endpoint_id", "call"], "left").groupBy("endpoint_id").agg(
        F.array_sort(F.collect_list(F.struct("_n", "call", "importance", "skip", "target_file", "target", F.coalesce(F.size("statements"), F.lit(-1)).alias("n"), "reason"))).alias("r")
    ).join(primary, "endpoint_id")
    done = "array<struct<pos:int,call:string,outcome:string,target_file:string,target:string,steps:int>>"
    start = F.struct(
        F.array(F.concat_ws("|", "file", "handler")).alias("seen"), F.array("file").alias("files"), F.col("steps").cast("int").alias("steps"), F.lit(False).alias("over"), F.array().cast(done).alias("done")
    )

    def step(s: Column, x: Column) -> Column:
        key = F.concat_ws("|", x["target_file"], x["target"])
        left = F.lit(budgets.steps) - s["steps"]
        outcome = chain([
            (x["skip"].isNotNull(), x["skip"]), (x["importance"] < 0, "low_importance"), (x["target"].isNull(), F.coalesce(x["reason"], F.lit("not_found"))), (F.array_contains(s["seen"], key), "cycle"),
            (F.size(s["seen"]) >= budgets.functions, "max_functions"), ((F.size(s["files"]) >= budgets.files) & ~F.array_contains(s["files"], x["target_file"]), "max_files"),
            (x["n"] <= 0, "slice_unavailable"), (left <= 0, "max_steps"),
        ], "followed")
        taken = F.when(outcome == "followed", F.least(x["n"], left)).otherwise(0)
        visits = outcome.isin("followed", "max_steps")
        row = F.struct(x["_n"].alias("pos"), x["call"].alias("call"), outcome.alias("outcome"), x["target_file"].alias("target_file"), x["target"].alias("target"), taken.alias("steps"))
        after = F.struct(
            F.when(visits, F.array_union(s["seen"], F.array(key))).otherwise(s["seen"]).alias("seen"), F.when(visits, F.array_union(s["files"], F.array(x["target_file"]))).otherwise(s["files"]).alias("files"),
            (s["steps"] + taken).alias("steps"), (outcome == "max_steps").alias("over"), F.concat(s["done"], F.array(row)).alias("done"),
        )
        return F.when(s["over"], s).otherwise(after)

    return rows.select("endpoint_id", F.explode(F.aggregate("r", start, step)["done"]).alias("d")).select("endpoint_id", "d.*")


def layered_steps(endpoints: DataFrame, statements: DataFrame, followed: DataFrame, callee_statements: DataFrame) -> DataFrame:
    """``endpoint_id, depth, ord, kind, name, detail``: the endpoint, its handler and first 40 statements, and each followed call with its first 6.

    ``statements`` (endpoint_id, index, kind_hint, text, signals); ``callee_statements`` (endpoint_id, target, index, kind_hint, text, signals).
    """
    own = endpoints.select("endpoint_id", F.lit(0).alias("depth"), F.lit(0).alias("ord"), F.lit("endpoint").alias("kind"), F.concat_ws(" ", F.coalesce("method", F.lit("ANY")), F.coalesce("path", F.lit("?"))).alias("detail"))
    head = endpoints.filter("handler IS NOT NULL").select("endpoint_id", F.lit(1).alias("depth"), F.lit(0).alias("ord"), F.lit("handler").alias("kind"), F.col("handler").alias("detail"))
    kind = kinds.step_kind(F.col("kind_hint"), F.col("signals"), F.col("text"))
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("index"))
    body = statements.withColumn("_n", nth("endpoint_id")).filter("_n <= 40").select("endpoint_id", F.lit(1).alias("depth"), F.col("_n").alias("ord"), kind.alias("kind"), F.col("text").alias("detail"))
    went = followed.filter("outcome = 'followed'")
    calls = went.select("endpoint_id", F.lit(2).alias("depth"), (F.col("pos") * 100).alias("ord"), F.lit("service_call").alias("kind"), F.col("target").alias("detail"))
    inner = callee_statements.join(went.select("endpoint_id", "target", "pos", "steps"), ["endpoint_id", "target"]).withColumn("_n", nth("endpoint_id", "target")).filter("_n <= 6 AND _n <= steps")
    inner = inner.select("endpoint_id", F.lit(2).alias("depth"), (F.col("pos") * 100 + F.col("_n")).alias("ord"), kind.alias("kind"), F.col("text").alias("detail"))
    every = own.unionByName(head).unionByName(body).unionByName(calls).unionByName(inner)
    return every.withColumn("name", kinds.step_name(F.col("kind"), F.col("detail")))


def next_steps(layered: DataFrame) -> DataFrame:
    """Edges between consecutive layered steps of an endpoint."""
    w = Window.partitionBy("endpoint_id").orderBy("depth", "ord")
    at = F.concat_ws(":", "depth", "ord")
    return layered.select("endpoint_id", F.lag(at).over(w).alias("source"), at.alias("target")).filter("source IS NOT NULL")
