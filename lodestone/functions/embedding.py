"""Embedding of semantic units in Arrow batches, with a pluggable provider."""

from __future__ import annotations

import sys
import time
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_SIZE = 100
RETRIES = 2
Provider = Callable[[list[str]], list[list[float]]]


def hashing_provider(dimensions: int = 768) -> Provider:
    """Deterministic stand-in for a model: signed word hashing, normalised to length one."""
    def embed(texts: list[str]) -> list[list[float]]:
        rows = []
        for text in texts:
            row = [0.0] * dimensions
            for word in text.lower().split():
                code = zlib.crc32(word.encode())
                row[code % dimensions] += 1.0 if code & 0x80000000 else -1.0
            norm = sum(x * x for x in row) ** 0.5
            rows.append([x / norm for x in row] if norm else row)
        return rows
    return embed


def _with_retry(provider: Provider, texts: list[str]) -> tuple[list[list[float] | None], str | None]:
    """Vectors of a batch and no error, or null vectors and the last error of a batch that keeps failing."""
    failure = None
    for attempt in range(RETRIES + 1):
        try:
            return list(provider(texts)), None
        except Exception as error:  # noqa: BLE001 - any provider failure is retried, then recorded
            failure = f"{type(error).__name__}: {error}"
            if attempt < RETRIES:
                time.sleep(2 ** attempt)
    return [None] * len(texts), failure


def embedder(provider: Provider) -> Callable[[Column], Column]:
    @F.pandas_udf("vector array<float>, error string")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.fillna("").tolist()
            vectors: list[list[float] | None] = []
            errors: list[str | None] = []
            for i in range(0, len(texts), BATCH_SIZE):
                made, failure = _with_retry(provider, texts[i:i + BATCH_SIZE])
                vectors += made
                errors += [failure] * len(made)
            yield pd.DataFrame({"vector": pd.Series(vectors, dtype=object), "error": pd.Series(errors, dtype=object)})
    return embed


def embed_units(units: DataFrame, provider: Provider | None = None, dimensions: int = 768) -> DataFrame:
    """``units`` with ``embedding`` and ``embedding_error``; where the provider failed the vector is null and the error says why."""
    embed = embedder(provider or hashing_provider(dimensions))
    made = units.withColumn("_made", embed(F.col("source_text")))
    return made.withColumns({"embedding": F.col("_made.vector"), "embedding_error": F.col("_made.error")}).drop("_made")
