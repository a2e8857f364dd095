"""Embedding and language models as providers that run beside the data; offline stand-ins give the same result each time."""

from __future__ import annotations

import hashlib
import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.text import truncate


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Model(Protocol):
    def __call__(self, prompt: str) -> str: ...


class HashEmbedder:
    """Words hashed to signed slots, length 1: texts that share words are near."""

    def __init__(self, width: int = 64):
        self.width = width

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.width)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.width] += 1 if h >> 32 & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


#: Statuses with a message of their own, and those below 500 after which a call is tried again.
MESSAGES = {401: "authentication failed", 413: "request too large", 429: "rate limit exceeded"}
AGAIN = (400, 401, 429)


class CallError(RuntimeError):
    """A failed call; retry says whether the same call may still succeed."""

    def __init__(self, message: str, retry: bool):
        super().__init__(message)
        self.retry = retry


def post(url: str, key: str, body: dict, timeout: float) -> dict:
    """The JSON answer of a call; CallError for statuses, lost connections, and answers that aren't JSON."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            text = answer.read()
    except urllib.error.HTTPError as x:
        said = MESSAGES.get(x.code, "server error" if x.code >= 500 else "call refused")
        raise CallError(f"{said} ({x.code})", x.code >= 500 or x.code in AGAIN) from x
    except OSError as x:
        raise CallError(f"no connection: {x}", True) from x
    try:
        return json.loads(text)
    except ValueError as x:
        raise CallError("the answer isn't JSON", False) from x


class HttpEmbedder:
    """Posts batches of texts; the answer's vectors must be as many as the texts, and of one width."""

    def __init__(self, url: str, key: str = "", model: str = "", timeout: float = 60):
        self.url, self.key, self.model, self.timeout = url, key, model, timeout

    def __call__(self, texts: list[str]) -> list[list[float]]:
        answer = post(self.url, self.key, {"input": texts, "model": self.model}, self.timeout)
        try:
            vectors = [[float(x) for x in r["embedding"]] for r in answer["data"]]
        except (KeyError, TypeError, ValueError) as x:
            raise CallError(f"the answer holds no vectors: {x!r}", False) from x
        return checked(vectors, len(texts))


class HttpModel:
    """Posts a prompt as a user's message to a chat endpoint; options (temperature, max_tokens) go along."""

    def __init__(self, url: str, key: str = "", model: str = "", timeout: float = 120, **options: float):
        self.url, self.key, self.model, self.timeout, self.options = url, key, model, timeout, options

    def __call__(self, prompt: str) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], **self.options}
        answer = post(f"{self.url.rstrip('/')}/chat/completions", self.key, body, self.timeout)
        try:
            text = answer["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as x:
            raise CallError(f"the answer holds no message: {x!r}", False) from x
        if text is None:
            raise CallError("the answer's message is empty", False)
        return text


class Pace:
    """How one task calls: at most `rate` calls a second, and batches whose size follows how the calls went."""

    #: Calls before the size changes; shares of success and seconds that halve and double it; the largest size.
    CALLS, LOW, HIGH, FAST, MOST = 10, 0.8, 0.95, 2.0, 64

    def __init__(self, batch: int = 32, rate: float | None = None, adaptive: bool = False, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.batch, self.rate, self.adaptive, self.clock, self.sleep = batch, rate, adaptive, clock, sleep
        self.last, self.good, self.failed, self.seconds = float("-inf"), 0, 0, 0.0

    def run(self, call: Callable, *args):
        if self.rate:
            self.sleep(max(0.0, self.last + 1 / self.rate - self.clock()))
        self.last = began = self.clock()
        try:
            out = call(*args)
        except Exception:
            self.failed += 1
            raise
        self.good += 1
        self.seconds += self.clock() - began
        return out

    def size(self) -> int:
        calls = self.good + self.failed
        if not self.adaptive or calls < self.CALLS:
            return self.batch
        share = self.good / calls
        if share < self.LOW:
            return max(1, self.batch // 2)
        return min(2 * self.batch, self.MOST) if share > self.HIGH and self.seconds / self.good < self.FAST else self.batch


def checked(vectors: list[list[float]], n: int) -> list[list[float]]:
    """The vectors, if they are n, of one width, and not empty."""
    if any(not v for v in vectors):
        raise ValueError("an empty vector")
    if len(vectors) != n or len({len(v) for v in vectors}) > 1:
        raise ValueError(f"{len(vectors)} vectors of widths {sorted({len(v) for v in vectors})} for {n} texts")
    return vectors


class TemplateModel:
    """Answers with the first words of the prompt's last paragraph."""

    def __init__(self, words: int = 8):
        self.words = words

    def __call__(self, prompt: str) -> str:
        return " ".join(prompt.strip().rsplit("\n\n", 1)[-1].split()[: self.words])


def delay(attempt: int, base: float = 1.0, factor: float = 2.0, most: float = 60.0, jitter: Callable[[], float] = random.random) -> float:
    """Seconds before the next attempt: exponential with a cap, and 10 to 50 % on top."""
    wait = min(most, base * factor**attempt)
    return wait * (1.1 + 0.4 * jitter())


def with_retries(call: Callable, attempts: int = 5, valid: Callable[[object], bool] = lambda _: True, base: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """call, repeated when it fails or its result isn't valid, unless the failure says that it is final; the last failure is raised."""

    def run(*args):
        problem: Exception = ValueError("no attempt")
        for k in range(attempts):
            try:
                out = call(*args)
                if valid(out):
                    return out
                problem = ValueError("the answer isn't valid")
            except Exception as x:  # noqa: BLE001
                problem = x
                if not getattr(x, "retry", True):
                    break
            if k + 1 < attempts and base:
                sleep(delay(k, base))
        raise problem

    return run


def _vectors(embedder: Embedder, texts: list[str], attempts: int, base: float, pace: Pace) -> list[list[float] | None]:
    try:
        return with_retries(lambda t: pace.run(lambda: checked(embedder(t), len(t))), attempts, base=base)(texts)
    except Exception:  # noqa: BLE001
        if len(texts) == 1:
            return [None]
        half = len(texts) // 2
        return _vectors(embedder, texts[:half], attempts, base, pace) + _vectors(embedder, texts[half:], attempts, base, pace)


def embed(rows: DataFrame, text: str, embedder: Embedder, characters: int = 512, batch: int = 32, out: str = "embedding", attempts: int = 3, base: float = 1.0, rate: float | None = None, adaptive: bool = False, timed: bool = False) -> DataFrame:
    """rows with the vector of each text's first characters (the model's own limit). A call that keeps failing is halved, so that one
    bad text doesn't take others along; a text that fails alone gets null.

    rate: most calls a second of one task; adaptive: batches grow and shrink with how the calls went; timed: status and
    duration (the call's seconds shared by its texts) too, for retention.call_stats()."""
    columns, extra = rows.columns, ["status", "duration"] if timed else []
    prepared = rows.withColumn("_text", truncate(F.col(text), characters))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` array<float>" + ", status string, duration double" * timed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(batch, rate, adaptive)
        for b in batches:
            texts, vectors, duration = b.column(len(columns)).to_pylist(), [], []
            while len(vectors) < len(texts):
                some, began = texts[len(vectors) : len(vectors) + pace.size()], time.monotonic()
                vectors += _vectors(embedder, some, attempts, base, pace)
                duration += [(time.monotonic() - began) / len(some)] * len(some)
            made = [pa.array(vectors, pa.list_(pa.float32()))]
            if timed:
                made += [pa.array(["error" if v is None else "success" for v in vectors], pa.string()), pa.array(duration, pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*columns, out, *extra])

    return prepared.mapInArrow(run, ddl)


def width(embedder: Embedder, probe: str = "probe") -> int:
    """Entries of the embedder's vectors, by one call."""
    return len(checked(embedder([probe]), 1)[0])


def generate(rows: DataFrame, prompt: str, model: Model, workers: int = 16, attempts: int = 5, base: float = 1.0, valid: Callable[[str], bool] = lambda s: bool(s.strip()), out: str = "output") -> DataFrame:
    """rows with the answer to each prompt, status and duration; a prompt that keeps failing gets `Error: ...`. Calls of a batch
    overlap in a bounded pool; rows keep their place."""
    columns = rows.columns
    at = columns.index(prompt)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` string, status string, duration double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = with_retries(model, attempts, valid, base)

        def one(p: str | None) -> tuple[str, str, float]:
            began = time.monotonic()
            try:
                return ask(p or ""), "success", time.monotonic() - began
            except Exception as x:  # noqa: BLE001
                return f"Error: {x}", "error", time.monotonic() - began

        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                made = list(pool.map(one, b.column(at).to_pylist()))
                extra = [pa.array([m[k] for m in made], pa.string() if k < 2 else pa.float64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*columns, out, "status", "duration"])

    return rows.mapInArrow(run, ddl)
