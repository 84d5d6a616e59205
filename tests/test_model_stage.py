"""Optional model stages, with a client that answers from a table."""

import json

from pyspark.sql import functions as F

from routeloom.functions.evidence import EVIDENCE
from routeloom.plans import model_stage as ms


class Stub:
    def generate(self, prompt):
        if "fail" in prompt:
            raise ms.ClientError("request timed out")
        return "```json\n" + json.dumps({"endpoints": [{"method": "GET", "path": "/a", "file": "a.py", "confidence": 7, "evidence": [{"file": "a.py", "label": "x"}]}, {"method": "GET", "path": "/b", "file": "gone.py"}]}) + "\n```"


def test_answers_become_endpoints(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, "fail")], "id long, p string")
    asked = ms.ask(rows, F.col("p"), Stub)
    got = {r["id"]: (r["answer"] is None, r["error"]) for r in asked.collect()}
    assert got == {1: (False, None), 2: (True, "network/connectivity failure: request timed out")}
    found = ms.answered_endpoints(asked.withColumn("asked", F.col("id")), spark.createDataFrame([("shop", "a.py")], "repo string, path string")).collect()
    assert [(r["method"], r["path"], r["repo"], r["confidence"], r["evidence"][0]["label"]) for r in found] == [("GET", "/a", "shop", 1.0, "x")]
    assert ms.ask(rows, F.col("p"), None).filter("answer IS NOT NULL").count() == 0


def test_specs_and_plans():
    assert ms.parse_model_spec("OpenAI: gpt:x ") == ("openai", "gpt:x") and ms.parse_model_spec("llama") == ("ollama", "llama")
    good = dict.fromkeys(ms.PLAN_TEXT, "x") | dict.fromkeys(ms.PLAN_LISTS, []) | {"confidence": 0.5}
    assert ms.plan_error(good) is None and ms.plan_error(good | {"risks": "x"}) == "risks must be a list" and ms.plan_error([]) == "not an object"


def test_grounding(spark):
    df = spark.createDataFrame([(["a"],), (["a", "z"],), ([],), (None,)], "i array<string>")
    assert [r[0] for r in df.select(ms.grounded(F.col("i"), F.array(F.lit("a"), F.lit("b")))).collect()] == [True, False, False, False]


def test_plan_routes(spark):
    rows = [("r", "get", "/a", None, "x.js", []), ("r", "GET", "/a", "h", "y.js", []), ("r", "TRACE", "/b", "h", "x.js", []), ("r", "GET", None, "h", "x.js", [])]
    df = spark.createDataFrame(rows, f"repo string, method string, path string, handler string, file string, evidence {EVIDENCE}")
    assert [(r["method"], r["path"], r["handler"], r["status"]) for r in ms.apply_plan(df, "express").collect()] == [("GET", "/a", "h", "deterministic_plan")]


def test_consistency(spark):
    contracts = spark.createDataFrame([("POST", ["201", "400"])], "method string, statuses array<string>")
    tests = spark.createDataFrame([("ok", "positive", "201", "responses.201"), ("old", "positive", "200", None), ("ref", "edge_case", None, "responses.500"), ("bare", "validation", None, None)], "name string, category string, status string, response_ref string")
    got = sorted(r["name"] for r in ms.consistency_warnings(contracts, tests).collect())
    assert got == ["bare", "old", "old", "ref"]
