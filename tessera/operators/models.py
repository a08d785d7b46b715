"""The surface for external models: embedders, generators and judges are plain callables handed in.

A callable goes to the executors as it is and gets a batch at a time; caching,
resuming, validation and retries are Spark's and ours.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]


def hash_embedder(width: int = 8) -> Embedder:
    """A deterministic stand-in: numbers from the text's digest."""

    def embed(texts: list[str]) -> list[list[float]]:
        return [[b / 255 - 0.5 for b in hashlib.sha256(t.encode()).digest()[:width]] for t in texts]

    return embed


def embed_missing(rows: DataFrame, cache: DataFrame, embedder: Embedder, *, text_col: str = "text", batch: int = 100) -> DataFrame:
    """``text_sha256, embedding`` of every distinct text that ``cache`` (same columns) lacks."""
    wanted = rows.select(F.sha2(text_col, 256).alias("text_sha256"), F.col(text_col).alias("t")).groupBy("text_sha256").agg(F.min("t").alias("t"))
    missing = wanted.join(cache.select("text_sha256"), "text_sha256", "left_anti")

    def run(frames):
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                yield pd.DataFrame({"text_sha256": part.text_sha256, "embedding": embedder(part.t.tolist())})

    return missing.mapInPandas(run, "text_sha256 string, embedding array<double>")


def embedded(rows: DataFrame, cache: DataFrame, *, text_col: str = "text") -> DataFrame:
    return rows.withColumn("text_sha256", F.sha2(text_col, 256)).join(cache, "text_sha256", "left")


def timed_embeddings(rows: DataFrame, embedder: Embedder, *, text_col: str = "text") -> DataFrame:
    """The rows with ``embedding`` and ``embedding_seconds``: one call a text, timed alone; a null text has neither."""
    at = rows.columns.index(text_col)

    def run(frames):
        for frame in frames:
            found = []
            for text in frame.iloc[:, at]:
                began = time.perf_counter()
                vector = None if text is None else embedder([text])[0]
                found.append((vector, None if text is None else time.perf_counter() - began))
            yield frame.assign(embedding=[v for v, _ in found], embedding_seconds=pd.array([s for _, s in found], "Float64"))

    return rows.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in [*rows.dtypes, ("embedding", "array<double>"), ("embedding_seconds", "double")]))


class BadRequest(Exception):
    """The service refuses the request as it is; the message says which parameter it does not take."""


class Unavailable(Exception):
    """The service cannot answer now; the same request may work later."""


@dataclass(frozen=True)
class Fallback:
    """What to do about a parameter that a refusal names: give it another name, or leave it out."""

    named: str
    rename: str | None = None

    def applied(self, params: dict, message: str) -> dict:
        if self.named not in message.lower() or self.named not in params:
            return params
        rest = {k: v for k, v in params.items() if k != self.named}
        return rest | {self.rename: params[self.named]} if self.rename else rest


#: The parameters that services of this kind take under another name or not at all.
FALLBACKS = (Fallback("max_tokens", "max_completion_tokens"), Fallback("temperature"))
_STAMP = "%Y-%m-%dT%H:%M:%SZ"
ANSWER = "answer_text string, finish_reason string, usage map<string, long>, request string, attempts int, elapsed_seconds double, generated_at string, problem string"


def utc_now() -> str:
    """The time in UTC, to the second."""
    return datetime.now(UTC).strftime(_STAMP)


def utc_timestamp() -> Column:
    """The time a query began, in UTC, to the second, as a column."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


class Generator:
    """Calls a service, adapting its parameters to what the service refuses; what was adapted stays so.

    ``ask`` takes the messages and the parameters and gives ``answer_text``, and
    ``finish_reason`` and ``usage`` if known; it raises :class:`BadRequest` or
    :class:`Unavailable`. A refusal that no fallback answers, and the last of
    ``attempts`` failures, are problems of the row.
    """

    def __init__(self, ask: Callable[..., dict], params: dict, *, fallbacks: Sequence[Fallback] = FALLBACKS, attempts: int = 4, wait: Callable[[int], None] = lambda n: time.sleep(min(30.0, 0.5 * 2**n))) -> None:
        self.ask, self.params, self.fallbacks, self.attempts, self.wait = ask, dict(params), fallbacks, attempts, wait

    def answer(self, messages: list[dict]) -> tuple:
        problem = None
        for n in range(1, self.attempts + 1):
            began = time.perf_counter()
            try:
                reply = self.ask(messages, **self.params)
            except BadRequest as refusal:
                problem, adapted = str(refusal), self.params
                for fallback in self.fallbacks:
                    adapted = fallback.applied(adapted, problem)
                if adapted == self.params:
                    break
                self.params = adapted
            except Unavailable as fault:
                problem = str(fault)
                if n < self.attempts:
                    self.wait(n)
            else:
                seconds = time.perf_counter() - began
                return reply["answer_text"], reply.get("finish_reason"), reply.get("usage"), json.dumps(self.params, sort_keys=True), n, seconds, utc_now(), None
        return None, None, None, json.dumps(self.params, sort_keys=True), n, None, utc_now(), problem


def generate(rows: DataFrame, ask: Callable[..., dict], params: dict, *key: str, messages: str = "messages", **settings) -> DataFrame:
    """``*key`` and the answer to each row's ``messages`` (an array of structs of role and content), with the request that worked, the seconds of its call and when.

    A task has one generator, so a parameter that the service refused is not tried
    again in it. Rows whose call failed have a ``problem`` and no answer, and can be
    taken up again by :func:`pending`.
    """
    kinds = dict(rows.dtypes)

    def run(frames):
        generator = Generator(ask, params, **settings)
        for frame in frames:
            for row in frame.itertuples(index=False):
                asked = [m.asDict() if hasattr(m, "asDict") else dict(m) for m in row[-1]]
                yield pd.DataFrame([(*row[:-1], *generator.answer(asked))], columns=[*key, *(c.split()[0] for c in _FIELDS)], dtype=object)

    return rows.select(*key, messages).mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in key) + ", " + ANSWER)


_FIELDS = re.split(r", (?=\w+ (?:string|map|int|double))", ANSWER)


def parse_object(reply: str | None) -> dict:
    """The JSON object of a reply, with fences or prose around it; not-a-number and infinity are errors."""

    def refuse(name):
        raise ValueError(f"not a finite number: {name}")

    text = re.sub(r"^```\w*\s*|\s*```$", "", (reply or "").strip())
    try:
        value = json.loads(text, parse_constant=refuse)
    except json.JSONDecodeError:
        found = re.search(r"\{.*\}", text, re.DOTALL)
        if not found:
            raise ValueError("no object in the reply") from None
        value = json.loads(found[0], parse_constant=refuse)
    if not isinstance(value, dict):
        raise ValueError("the reply is not an object")
    return value


def violations(value: dict, schema: dict) -> list[str]:
    """What of a small JSON schema the object breaks: required and further fields, types, ranges, multiples and array items."""
    kinds = {"string": str, "boolean": bool, "array": list, "number": (int, float), "integer": int, "object": dict, "null": type(None)}

    def fits(x, kind) -> bool:
        wanted = kind if isinstance(kind, list) else [kind]
        return any(isinstance(x, kinds[k]) and (k not in ("number", "integer") or not isinstance(x, bool)) for k in wanted)

    fields = schema.get("properties", {})
    out = [f"missing {k}" for k in schema.get("required", []) if k not in value]
    if schema.get("additionalProperties", True) is False:
        out += [f"unknown {k}" for k in value if k not in fields]
    for name, rule in fields.items():
        if name not in value:
            continue
        x = value[name]
        if "type" in rule and not fits(x, rule["type"]):
            out.append(f"type of {name}")
        elif isinstance(x, (int, float)) and not isinstance(x, bool):
            if x < rule.get("minimum", x) or x > rule.get("maximum", x):
                out.append(f"range of {name}")
            step = rule.get("multipleOf")
            if step and abs(x / step - round(x / step)) * step > 1e-9:
                out.append(f"step of {name}")
        elif isinstance(x, list) and "type" in rule.get("items", {}) and not all(fits(i, rule["items"]["type"]) for i in x):
            out.append(f"items of {name}")
    return out


def judge(answers: DataFrame, ask: Callable[[str, str], str], schema: dict, *, attempts: int = 3) -> DataFrame:
    """``query_id, condition_id, score, abstains, justified, attempts, problem``; a bad reply's faults go into the next attempt."""

    def one(prompt: str) -> tuple:
        fault = ""
        for n in range(1, attempts + 1):
            try:
                value = parse_object(ask(prompt, fault))
                broken = violations(value, schema)
                if not broken and value.get("abstains") and not isinstance(value.get("justified"), bool):
                    broken = ["justified must be given for an abstention"]
                if not broken:
                    return float(value["score"]), value.get("abstains"), value.get("justified"), n, None
                fault = "; ".join(broken)
            except ValueError as e:
                fault = str(e)
        return None, None, None, attempts, fault

    def run(frames):
        for frame in frames:
            got = pd.DataFrame([one(t) for t in frame.text], columns=["score", "abstains", "justified", "attempts", "problem"], dtype=object)
            yield pd.concat([frame[["query_id", "condition_id"]].reset_index(drop=True), got], axis=1)

    return answers.select("query_id", "condition_id", "text").mapInPandas(run, "query_id long, condition_id string, score double, abstains boolean, justified boolean, attempts int, problem string")


def pending(answers: DataFrame, scores: DataFrame, *same: str) -> DataFrame:
    """Answers without a score; a score whose ``same`` fields differ from the answer's is stale and an error."""
    key = ["query_id", "condition_id"]
    theirs = scores.select(*key, *(F.col(c).alias(f"__{c}") for c in same), F.lit(True).alias("__scored"))
    joined = answers.join(theirs, key, "left")
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"__{c}"))
    todo = F.when(F.col("__scored").isNull(), True).when(equal, False).otherwise(F.raise_error(F.lit("a stored score is stale")).cast("boolean"))
    return joined.where(todo).select(answers.columns)
