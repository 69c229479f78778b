"""Embedding source: a provider behind an Arrow batch function, and an offline one that hashes words."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 3500
Provider = Callable[[list[str]], list[list[float] | None]]


def unit(values: list[float] | None) -> list[float] | None:
    """Unit vector of the finite values; None without any or of length zero."""
    kept = [float(v) for v in values or [] if math.isfinite(v)]
    norm = math.sqrt(sum(v * v for v in kept))
    return [v / norm for v in kept] if norm else None


def hashing_provider(dimensions: int = 64) -> Provider:
    """Signed word hashing: deterministic, needs no network, and similar texts get similar vectors."""

    def embed(texts: list[str]) -> list[list[float] | None]:
        out = []
        for text in texts:
            v = [0.0] * dimensions
            for word in text.lower().split():
                h = int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:8], 16)
                v[h % dimensions] += 1.0 if h >> 31 else -1.0
            out.append(v if any(v) else None)
        return out

    return embed


def embed_column(text: Column, provider: Provider, batch: int = 128, failures=None) -> Column:
    """Unit vectors of texts trimmed to ``MAX_CHARS``; null where the provider gives none or fails.

    ``failures``: an accumulator that counts the texts of batches for which the provider raised.
    """

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = [(t or "").strip()[:MAX_CHARS] for t in part]
            out: list = []
            for at in range(0, len(texts), batch):
                asked = texts[at : at + batch]
                try:
                    got = provider(asked)
                except Exception:  # a provider's failure leaves chunks without vectors; search then scores them 0
                    got = [None] * len(asked)
                    if failures is not None:
                        failures.add(len(asked))
                out += [unit(v) for v in got]
            yield pd.Series(out, dtype=object)

    # not deterministic for the planner: a filter on the vectors isn't moved below, which would ask the provider twice
    return run.asNondeterministic()(text)


def chunk_embeddings(chunks: DataFrame, provider: Provider, model: str, failures=None) -> DataFrame:
    """chunk_id, model and vector of chunks that got one."""
    vector = embed_column(F.col("text"), provider, failures=failures).alias("vector")
    made = chunks.select("chunk_id", F.lit(model).alias("model"), vector)
    return made.where("vector is not null")
