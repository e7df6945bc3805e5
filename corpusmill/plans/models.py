"""The one place where a language model is called: backends that turn a prompt column into replies.

A backend is a function from a frame with prompt_id, attempt and prompt to a frame with prompt_id, attempt, reply, status, seconds. The mock and the
replay are expressions and joins; the HTTP backend runs in Arrow batches with one connection a task. Replies of a real model differ from call to
call, so callers write them down before they use them twice (see loops.Ledger). Errors are data: a failed call has a status and no reply.
"""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, words

Backend = Callable[[DataFrame], DataFrame]
REPLY = "prompt_id string, attempt int, reply string, status string, seconds double"


def md5_number(x: Column, digits: int = 2) -> Column:
    """The first hexadecimal digits of a text's MD5 as a number: a hash that other engines have too."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, digits), 16, 10).cast("long")


def _reply(prompts: DataFrame, reply) -> DataFrame:
    return prompts.select(F.col("prompt_id").cast("string"), F.col("attempt").cast("int"), reply.alias("reply"), F.lit("ok").alias("status"), F.lit(0.0).alias("seconds"))


def mock_summary(prompts: DataFrame) -> DataFrame:
    """A fixed record whose summary is the start of the text between document tags."""
    text = strip(F.regexp_extract("prompt", r"(?s)<document>(.*?)</document>", 1))
    summary = F.array_join(F.slice(words(text), 1, 60), " ")
    record = F.struct(
        F.lit("Mock title").alias("title"), F.lit("Mock body").alias("issuing_body"), F.lit("Not stated").alias("country_or_region"), F.lit("unknown").alias("year"),
        F.lit("Report").alias("document_type"), summary.alias("summary"), F.array(F.lit("skills"), F.lit("training"), F.lit("policy")).alias("keywords"),
    )
    return _reply(prompts, F.to_json(record))


def mock_answer(bad_every: int = 4) -> Backend:
    """Cites the first source; every bad_every-th prompt, by hash, cites nothing at its first attempt."""

    def backend(prompts: DataFrame) -> DataFrame:
        bad = (md5_number(F.col("prompt_id")) % bad_every == 0) & (F.col("attempt") == 1)
        return _reply(prompts, F.when(bad, "An answer without any source.").otherwise("The sources say so [S1]."))

    return backend


def mock_objective(bad_first: bool = True) -> Backend:
    """An objective for the topic between topic tags; the first attempt is wordy unless the prompt holds a rule about length."""

    def backend(prompts: DataFrame) -> DataFrame:
        topic = strip(F.regexp_extract("prompt", r"(?s)<topic>(.*?)</topic>", 1))
        bad = (F.col("attempt") == 1) & ~F.lower("prompt").contains("at most 20 words") & F.lit(bad_first)
        return _reply(prompts, F.when(bad, F.concat(F.lit("Learners will understand "), topic)).otherwise(F.concat(F.lit("Explain "), topic, F.lit("."))))

    return backend


def replay(recorded: DataFrame) -> Backend:
    """Replies from a table prompt_id, attempt, reply; a prompt without one has the status missing."""

    def backend(prompts: DataFrame) -> DataFrame:
        known = recorded.select(F.col("prompt_id").cast("string"), F.col("attempt").cast("int"), "reply")
        rows = prompts.select(F.col("prompt_id").cast("string"), F.col("attempt").cast("int")).join(known, ["prompt_id", "attempt"], "left")
        return rows.select("prompt_id", "attempt", "reply", F.when(F.col("reply").isNull(), "missing").otherwise("ok").alias("status"), F.lit(0.0).alias("seconds"))

    return backend


def http(url: str, model: str, style: str = "completion", temperature: float = 0.0, most_tokens: int = 400, timeout: float = 120.0) -> Backend:
    """A model server: completion sends the prompt, chat a list of messages."""

    def call(prompt: str) -> str:
        body: dict = {"model": model, "stream": False, "options": {"temperature": temperature, "num_predict": most_tokens}}
        body |= {"prompt": prompt} if style == "completion" else {"messages": [{"role": "user", "content": prompt}]}
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            data = json.load(answer)
        return data["response"] if style == "completion" else data["message"]["content"]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for p, a, text in zip(batch["prompt_id"], batch["attempt"], batch["prompt"]):
                began = time.monotonic()
                try:
                    reply, status = call(text), "ok"
                except (OSError, KeyError, ValueError) as e:
                    reply, status = None, f"error: {type(e).__name__}"
                rows.append((p, a, reply, status, time.monotonic() - began))
            yield pd.DataFrame(rows, columns=["prompt_id", "attempt", "reply", "status", "seconds"]).astype({"attempt": "int32"})

    return lambda prompts: prompts.select(F.col("prompt_id").cast("string"), F.col("attempt").cast("int"), "prompt").mapInPandas(run, REPLY)


def _posted(url: str, body: dict | None, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode() if body is not None else None, {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


#: What a call may fail with: no server, no such field, no JSON.
FAILURES = (OSError, KeyError, TypeError, ValueError)


def installed(url: str, timeout: float = 5.0) -> list[str]:
    """Names of the models that a server has; none where there is no server."""
    try:
        return sorted(m["name"] for m in _posted(f"{url}/api/tags", None, timeout)["models"])
    except FAILURES:
        return []


def is_ready(names: list[str], model: str) -> bool:
    """A name without a tag also means its latest."""
    return model in names or f"{model}:latest" in names


def prompt_tokens(url: str, model: str, timeout: float = 120.0) -> Backend:
    """prompt_id and the number of tokens that the server says a prompt has; null where the call fails. The answer itself is thrown away."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            counts = []
            for text in batch["prompt"]:
                try:
                    counts.append(int(_posted(f"{url}/api/generate", {"model": model, "prompt": text, "stream": False, "options": {"num_predict": 1}}, timeout)["prompt_eval_count"]))
                except FAILURES:
                    counts.append(None)
            yield pd.DataFrame({"prompt_id": batch["prompt_id"], "tokens": pd.array(counts, "Int64")})

    return lambda prompts: prompts.select(F.col("prompt_id").cast("string"), "prompt").mapInPandas(run, "prompt_id string, tokens long")


def http_embeddings(url: str, model: str, together: int = 32, timeout: float = 120.0) -> Backend:
    """key and vector of a frame with key and text. Texts are sent together; where that fails or gives another number of vectors, one by one to
    the older address; a text that fails there too has a null vector."""

    def alone(text: str) -> list[float] | None:
        try:
            return list(map(float, _posted(f"{url}/api/embeddings", {"model": model, "prompt": text}, timeout)["embedding"])) or None
        except FAILURES:
            return None

    def vectors(texts: list[str]) -> list[list[float] | None]:
        try:
            found = [list(map(float, v)) for v in _posted(f"{url}/api/embed", {"model": model, "input": texts}, timeout)["embeddings"]]
        except FAILURES:
            found = []
        return found if len(found) == len(texts) and all(found) else list(map(alone, texts))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            out = [v for i in range(0, len(texts), together) for v in vectors(texts[i : i + together])]
            yield pd.DataFrame({"key": batch["key"], "vector": out})

    return lambda rows: rows.select(F.col("key").cast("string"), "text").mapInPandas(run, "key string, vector array<double>")


def whole_or_none(embedded: DataFrame) -> DataFrame:
    """Vectors as they are if no row lacks one; else all are null, and ranking goes by keywords alone. Store embedded first: it is read twice."""
    gap = embedded.agg(F.coalesce(F.bool_or(F.col("vector").isNull()), F.lit(False)).alias("_gap"))
    return embedded.crossJoin(F.broadcast(gap)).select("key", F.when(~F.col("_gap"), F.col("vector")).alias("vector"))  # one row


def choose(name: str | None, definition: dict, default: str = "mock") -> str:
    """A backend's name: what the caller says, else the environment, else the agent's definition, else the default."""
    return name or os.environ.get("CORPUSMILL_BACKEND") or definition.get("backend") or default


def fake_embedding(x, size: int = 64):
    """A hashed bag of words of unit length, the same in every run; zeros for a text without words."""
    from ..functions.text import tokens

    places = F.transform(tokens(x), lambda t: md5_number(t) % size)
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(counts, lambda v: F.when(length == 0, F.lit(0.0)).otherwise(v / length))
