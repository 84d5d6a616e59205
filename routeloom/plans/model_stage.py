"""Optional stages that ask a language model; off unless a client is given, and everything else works without.

A client is anything with ``generate(prompt) -> text``. Prompts go out from the executors, one client for each
task, and answers come back as text with an error column: a failed call is a row, not a failed job. Answers
are data: they pass the same filters and merges as what parsers find, and ids in them must be those of the input.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol
from urllib import error, request

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions import kinds, text
from routeloom.functions.evidence import EVIDENCE
from routeloom.operators import relational


class Client(Protocol):
    def generate(self, prompt: str) -> str: ...


class ClientError(RuntimeError):
    """A call that gave no usable answer."""


def parse_model_spec(spec: str, default: str = "ollama") -> tuple[str, str]:
    """``provider:model``, or a model of the default provider."""
    provider, colon, model = spec.strip().partition(":")
    if not colon:
        provider, model = default, provider
    provider, model = provider.strip().lower(), model.strip()
    if not provider or not model:
        raise ClientError(f"expected provider:model, got {spec!r}")
    return provider, model


@dataclass
class HttpClient:
    """Posts JSON to a completion endpoint. ``answer``: the keys that lead to the text; without ``prompt_key`` the body holds the prompt."""

    url: str
    body: dict
    prompt_key: str | None = "prompt"
    answer: tuple = ("response",)
    timeout: float = 90.0
    headers: dict | None = None

    def generate(self, prompt: str) -> str:
        data = json.dumps(self.body | ({self.prompt_key: prompt} if self.prompt_key else {})).encode()
        call = request.Request(self.url, data, {"Content-Type": "application/json"} | (self.headers or {}))
        try:
            with request.urlopen(call, timeout=self.timeout if self.timeout > 0 else 90.0) as reply:
                found = json.loads(reply.read())
        except error.HTTPError as e:
            raise ClientError(f"model not available: {e.code}" if e.code == 404 else f"request failed ({e.code})") from e
        except (error.URLError, TimeoutError) as e:
            raise ClientError(f"unavailable at {self.url}: {e}") from e
        except ValueError as e:
            raise ClientError("answer is not valid JSON") from e
        for key in self.answer:
            try:
                found = found[key]
            except (KeyError, IndexError, TypeError) as e:
                raise ClientError("missing completion text") from e
        return found


@dataclass(frozen=True)
class Provider:
    """Where a provider listens, and what a request to it looks like. ``key``: the header that carries the key, with ``{key}`` in its value."""

    url: str
    path: str
    body: dict
    answer: tuple
    key: tuple | None = None
    headers: dict | None = None
    chat: bool = True


# Request and answer shapes of the providers.
PROVIDERS = {
    "ollama": Provider("http://localhost:11434", "/api/generate", {"stream": False, "keep_alive": "5m"}, ("response",), chat=False),
    "openai": Provider("https://api.openai.com/v1", "/chat/completions", {}, ("choices", 0, "message", "content"), ("Authorization", "Bearer {key}")),
    "anthropic": Provider("https://api.anthropic.com", "/v1/messages", {"max_tokens": 4096}, ("content", 0, "text"), ("x-api-key", "{key}"), {"anthropic-version": "2023-06-01"}),
}


@dataclass
class ProviderClient:
    """A client of one of :data:`PROVIDERS`."""

    provider: str
    model: str
    key: str | None = None
    url: str | None = None
    timeout: float = 90.0
    temperature: float = 0.0
    system: str | None = None

    def request(self, prompt: str) -> tuple[str, dict, dict]:
        """URL, headers and body of the request for a prompt."""
        p = PROVIDERS.get(self.provider)
        if p is None:
            raise ClientError(f"unknown provider {self.provider}")
        if p.key and not self.key:
            raise ClientError(f"{self.provider}: api key is not configured")
        body = {"model": self.model, **p.body}
        if p.chat:
            own = {"role": "user", "content": prompt}
            inline = self.provider == "openai" and self.system
            body |= {"messages": [{"role": "system", "content": self.system}, own] if inline else [own], "temperature": self.temperature}
            body |= {"system": self.system} if self.system and not inline else {}
        else:
            body |= {"prompt": prompt, "options": {"temperature": self.temperature}, **({"system": self.system} if self.system else {})}
        headers = {**(p.headers or {}), **({p.key[0]: p.key[1].format(key=self.key)} if p.key else {})}
        return (self.url or p.url).rstrip("/") + p.path, headers, body

    def generate(self, prompt: str) -> str:
        url, headers, body = self.request(prompt)
        return HttpClient(url, body, None, PROVIDERS[self.provider].answer, self.timeout, headers).generate(prompt)


def client_from_settings(spec: str, settings: dict[str, str]) -> ProviderClient:
    """A client for ``provider:model``; ``settings``: ``<provider>_key``, ``<provider>_url``, ``timeout`` (positive, else 90) and ``temperature`` (0 to 1)."""
    provider, model = parse_model_spec(spec)
    timeout = float(settings.get("timeout", 90))
    heat = min(1.0, max(0.0, float(settings.get("temperature", 0))))
    return ProviderClient(provider, model, settings.get(f"{provider}_key"), settings.get(f"{provider}_url"), timeout if timeout > 0 else 90.0, heat)


def preflight(client, models: Callable[[], list[str]] | None = None) -> tuple[bool, str | None]:
    """Whether a client can be asked, and why not. ``models`` lists what its server has; where it cannot, a small prompt is tried."""
    try:
        if models is not None:
            known = models()
            if client.model in known:
                return True, None
            return False, f"model not available: {client.model}; available: {', '.join(known[:8]) or 'none'}"
    except (ClientError, OSError, ValueError):
        pass
    try:
        client.generate('Return JSON: {"ok":true}')
    except ClientError as e:
        return False, str(e)
    return True, None


def ask(rows: DataFrame, prompt: Column, make_client: Callable[[], Client] | None) -> DataFrame:
    """``rows`` with ``answer`` and ``error``; without a client, nothing is asked and both are null."""
    if make_client is None:
        return rows.withColumns({"answer": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    columns, width = rows.columns, len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        for batch in batches:
            answers, errors = [], []
            for p in batch.column(width).to_pylist():
                try:
                    answers.append(client.generate(p or ""))
                    errors.append(None)
                except ClientError as e:
                    answers.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=[*columns, "answer", "error"])

    schema = rows.schema.add("answer", "string").add("error", "string")
    asked = rows.withColumn("_prompt", prompt).mapInArrow(run, schema)
    return asked.withColumn("error", F.when(F.col("error").isNotNull(), F.concat_ws(": ", kinds.error_class(F.col("error")), "error")))


def discovery_prompt(files: Column) -> Column:
    """Asks for route declarations in ``files`` (array of struct(repo, path, role, text)), as JSON."""
    task = (
        "List the HTTP routes that these files declare or register. Calls to routes, tests and documentation are not declarations. "
        "Use null for what is unclear, and list nothing that the files do not show. Answer with JSON only: "
        '{"endpoints": [{"method", "path", "handler", "file", "repo", "service", "evidence": [{"file", "symbol", "label", "snippet"}], "confidence", "status"}]}\n'
    )
    return F.concat(F.lit(task), F.to_json(F.struct(files.alias("files"))))


def answered_endpoints(answers: DataFrame, known: DataFrame) -> DataFrame:
    """Endpoints in model answers, in the shape that merging takes. An object with ``endpoints`` or a plain list will do.

    ``answers``: answer, and a column ``asked`` by which they are told apart and ordered. Endpoints come behind those that were found in files.
    A missing repo is that of the named file, if ``known`` (repo, path) has one; files that are not known are dropped.
    """
    one = f"struct<method:string,path:string,handler:string,file:string,repo:string,service:string,evidence:{EVIDENCE},confidence:double,status:string>"
    body = text.json_payload(F.col("answer")).cast("string")
    found = F.coalesce(F.from_json(body, f"struct<endpoints:array<{one}>>")["endpoints"], F.from_json(body, f"array<{one}>"))
    rows = answers.select("asked", F.posexplode(found).alias("pos", "e")).select("asked", "e.*", "pos")
    where = known.groupBy(F.col("path").alias("file")).agg(F.min("repo").alias("_repo"))
    named = rows.join(where, "file").withColumn("repo", F.coalesce(F.nullif("repo", F.lit("")), "_repo"))
    return relational.numbered(named, ["repo"], "asked", [F.col("pos")]).select(
        (F.col("ord") + F.lit(1 << 40)).alias("ord"), *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in ("method", "path", "handler")], "file", "repo", "service", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")).alias("confidence"), "status", F.coalesce("evidence", F.array().cast(EVIDENCE)).alias("evidence"),
    )


def grounded(ids: Column, known: Column) -> Column:
    """Whether a list of ids in an answer is there and holds only ids of the input."""
    return F.coalesce((F.size(ids) > 0) & F.forall(ids, lambda i: F.array_contains(known, i)), F.lit(False))


#: Fields of a routing plan that must be strings, and lists.
PLAN_TEXT = ("version", "repo", "framework_family", "routing_convention", "recommended_next_action")
PLAN_LISTS = ("route_container_patterns", "route_declaration_patterns", "mount_patterns", "entrypoint_hints", "route_dir_hints", "ignore_hints", "risks")


def plan_error(plan: dict) -> str | None:
    """What is wrong with a routing plan; None if nothing is."""
    if not isinstance(plan, dict):
        return "not an object"
    for k in PLAN_TEXT:
        if not isinstance(plan.get(k), str):
            return f"{k} must be a string"
    if isinstance(plan.get("confidence"), bool) or not isinstance(plan.get("confidence"), (int, float)):
        return "confidence must be a number"
    return next((f"{k} must be a list" for k in PLAN_LISTS if not isinstance(plan.get(k), list)), None)


def apply_plan(composed: DataFrame, convention: str) -> DataFrame:
    """Composed routes (repo, method, path, handler, file, evidence) as routes of a plan: one each, one with a handler first."""
    shown = F.struct(F.col("file"), F.col("handler").alias("symbol"), F.lit("routing_pattern_plan").alias("label"), F.lit(f"derived using routing_pattern_plan: {convention}").alias("snippet"))
    rows = composed.filter(F.upper("method").isin("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "ALL") & F.col("path").isNotNull() & F.col("file").isNotNull())
    row = F.struct("handler", "file", F.concat("evidence", F.array(shown)).alias("evidence"))
    best = rows.groupBy("repo", F.upper("method").alias("method"), "path").agg(F.min_by(row, F.struct(F.col("handler").isNull(), "file", "handler")).alias("r"))
    return best.select("repo", "method", "path", "r.*", F.lit(1.0).alias("confidence"), F.lit("deterministic_plan").alias("status"))


def consistency_warnings(contracts: DataFrame, tests: DataFrame) -> DataFrame:
    """``name, warning``: scenarios at odds with the contracts' statuses. ``contracts`` (method, statuses), ``tests`` (name, category, status, response_ref)."""
    known = contracts.select(F.explode("statuses").alias("status")).distinct()
    traits = contracts.agg(
        F.coalesce(F.max((F.upper("method") == "POST") & F.array_contains("statuses", "201") & ~F.array_contains("statuses", "200")), F.lit(False)).alias("only_201"),
        F.coalesce(F.max(F.array_contains("statuses", "400")), F.lit(False)).alias("has_400"),
    ).first()
    missing = tests.filter("status IS NOT NULL").join(known, "status", "left_anti").select("name", F.lit("status is absent from contract responses").alias("warning"))
    refs = tests.filter("response_ref IS NOT NULL").withColumn("status", F.substring_index(F.regexp_replace("response_ref", r"^[^.]*\.", ""), ".", -1)).join(known, "status", "left_anti")
    out = missing.unionByName(refs.select("name", F.lit("response reference is missing from the contract").alias("warning")))
    low = F.lower("category")
    if traits["only_201"]:
        out = out.unionByName(tests.filter((low == "positive") & (F.col("status") == "200")).select("name", F.lit("expects 200 while the contract prefers 201").alias("warning")))
    if traits["has_400"]:
        out = out.unionByName(tests.filter((low == "validation") & F.col("status").isNull()).select("name", F.lit("has no status despite a 400 response").alias("warning")))
    return out
