"""Extension points: text extractors, embedders, retry."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol, TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame

T = TypeVar("T")


class Extractor(Protocol):
    """Text of a file's bytes; made once a task by its factory."""

    def extract(self, content: bytes) -> str: ...


EXTRACTORS: dict[str, Callable[[], Extractor]] = {}


def extractor(name: str) -> Callable[[Callable[[], Extractor]], Callable[[], Extractor]]:
    """Register a factory under ``name``."""

    def add(factory: Callable[[], Extractor]) -> Callable[[], Extractor]:
        EXTRACTORS[name] = factory
        return factory

    return add


@extractor("plain")
class PlainText:
    """UTF-8 text as it is."""

    def extract(self, content: bytes) -> str:
        return content.decode("utf-8", "replace")


def extracted(files: DataFrame, first: Callable[[], Extractor], second: Callable[[], Extractor] | None = None, least: int = 100, key: str = "path", content: str = "content") -> DataFrame:
    """key, text, status, error; the second extractor is asked where the first fails.

    A text below ``least`` characters is a failure.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [f() for f in (first, second) if f]
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                text, error = None, "no content"
                for engine in made if data is not None else []:
                    try:
                        text = engine.extract(data)
                        error = None if len(text) >= least else f"text of {len(text)} characters"
                    except Exception as e:  # a file's failure is its status
                        text, error = None, str(e)
                    if error is None:
                        break
                rows.append((text if error is None else None, "Failed" if error else "Processed", error))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.string()) for k in range(3))], names=["key", "text", "status", "error"])

    return files.select(files[key].cast("string").alias("key"), files[content].cast("binary").alias("c")).mapInArrow(run, "key string, text string, status string, error string")


Embedder = Callable[[list[str]], list[list[float]]]


def halving(embed: Embedder, texts: list[str]) -> list[list[float] | None]:
    """Vectors of all texts; a batch that fails is halved, a single text that fails has none."""
    try:
        return list(embed(texts))
    except Exception:
        if len(texts) <= 1:
            return [None] * len(texts)
        half = len(texts) // 2
        return [*halving(embed, texts[:half]), *halving(embed, texts[half:])]


def embedded(rows: DataFrame, make: Callable[[], Embedder], key: str, text: str, batch: int = 32) -> DataFrame:
    """key, dense of every row; the embedder is made once a task and asked for ``batch`` texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = make()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            vectors = [v for k in range(0, len(texts), batch) for v in halving(embed, texts[k : k + batch])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["key", "dense"])

    return rows.select(rows[key].cast("string").alias("key"), rows[text].cast("string").alias("t")).mapInArrow(run, "key string, dense array<float>")


def retried(call: Callable[[], T], tries: int = 3, base: float = 1.0, most: float = 30.0, jitter: float = 0.1, sleep: Callable[[float], None] = time.sleep, on: tuple[type[Exception], ...] = (Exception,)) -> T:
    """``call()``, again after a growing pause while it raises one of ``on``; the last failure is raised."""
    for attempt in range(tries):
        try:
            return call()
        except on:
            if attempt + 1 == tries:
                raise
            pause = min(base * 2**attempt, most)
            sleep(pause + random.uniform(0, jitter * pause))
    raise ValueError("no tries")
