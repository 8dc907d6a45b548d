"""Model and network calls behind one small interface, with retries and id checks.

A provider is a picklable object with ``answer(texts) -> list[str]``. Calls run inside Arrow
batches on the executors; a batch that keeps failing marks its own rows instead of losing or
mislabelling others.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.operators import cache as C
from scriptloom.session import map_arrow


class Provider(Protocol):
    name: str

    def answer(self, texts: list[str]) -> list[str]: ...


class EchoTranslator:
    """Deterministic stand-in: words reversed in a frame, so tests can tell texts apart."""

    name = "echo"

    def answer(self, texts: list[str]) -> list[str]:
        return ["«" + " ".join(reversed(t.split())) + "»" for t in texts]


class Unreliable:
    """Wraps a provider: loses the last answer of every ``every``-th call, or fails the first calls."""

    def __init__(self, inner: Provider, every: int = 0, failures: int = 0):
        self.inner, self.every, self.failures, self.calls, self.name = inner, every, failures, 0, inner.name

    def answer(self, texts: list[str]) -> list[str]:
        self.calls += 1
        if self.calls <= self.failures:
            raise TimeoutError("429 too many requests")
        found = self.inner.answer(texts)
        return found[:-1] if self.every and self.calls % self.every == 0 else found


_FACTORY: dict[str, Callable[[], Provider]] = {"echo": EchoTranslator}


def register(name: str, make: Callable[[], Provider]) -> None:
    """Make a provider known by name."""
    _FACTORY[name] = make


def create(name: str) -> Provider:
    if name not in _FACTORY:
        raise ValueError(f"unknown provider {name}; known: {', '.join(sorted(_FACTORY))}")
    return _FACTORY[name]()


def retryable(error: Exception) -> bool:
    """Rate limits, server errors and timeouts are worth another attempt."""
    text = str(error).lower()
    return isinstance(error, (TimeoutError, ConnectionError)) or any(x in text for x in ("429", "500", "502", "503", "504", "timeout", "timed out"))


def attempt(provider: Provider, texts: list[str], attempts: int = 3, wait_s: float = 1.0, most_s: float = 8.0) -> list[str | None]:
    """Answers with retries and growing waits (R06); a wrong number of answers falls back to single calls.

    Texts without an answer get None.
    """
    pause = wait_s
    for k in range(attempts):
        try:
            found = provider.answer(texts)
            if len(found) == len(texts):
                return list(found)
            break
        except Exception as error:
            if k + 1 == attempts or not retryable(error):
                break
            time.sleep(pause)
            pause = min(most_s, 2 * pause)
    if len(texts) == 1:
        return [None]
    return [attempt(provider, [t], attempts, wait_s, most_s)[0] for t in texts]


def ask(rows: DataFrame, provider: Provider, column: str, result: str, batch: int = 10, wait_s: float = 1.0) -> DataFrame:
    """Adds ``result`` and ``failed`` (Y01-Y05, Y07-Y12). Rows are asked in batches within their partition."""
    from pyspark.sql.types import BooleanType, StringType, StructField, StructType

    at = rows.columns.index(column)
    schema = StructType([*rows.schema.fields, StructField(result, StringType()), StructField("failed", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            answers: list[str | None] = []
            for k in range(0, len(texts), batch):
                answers += attempt(provider, texts[k : k + batch], wait_s=wait_s)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(answers, pa.string()), pa.array([a is None for a in answers], pa.bool_())], names=[*b.schema.names, result, "failed"]
            )

    return map_arrow(rows, run, schema)


def ask_cached(rows: DataFrame, cache: DataFrame, provider: Provider, column: str, result: str) -> tuple[DataFrame, DataFrame]:
    """Answers from the cache where it has them; only distinct missing texts are asked. Also the grown cache."""
    keyed = rows.withColumn("content_hash", C.cache_key(F.col(column)))
    todo = C.misses(keyed.select("content_hash", column).dropDuplicates(["content_hash"]), cache, ["content_hash"])
    fresh = ask(todo, provider, column, result).where(~F.col("failed")).select("content_hash", F.col(result).alias("value"))
    grown = cache.select("content_hash", "value").unionByName(fresh)
    unique = grown.groupBy("content_hash").agg(F.min("value").alias(result))
    return keyed.join(unique, "content_hash", "left").drop("content_hash"), grown


def fill_missing(rows: DataFrame, provider: Provider) -> DataFrame:
    """Rows without a translation get one (Y18); the others are not asked."""
    lacking = F.trim(F.coalesce("translated_text", F.lit(""))) == ""
    asked = ask(rows.where(lacking), provider, "text", "answer").withColumn("translated_text", F.coalesce("answer", "translated_text")).drop("answer", "failed")
    return rows.where(~lacking).unionByName(asked)
