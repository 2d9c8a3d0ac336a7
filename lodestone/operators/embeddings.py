"""Embedding texts through a provider, in batches inside tasks."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    """What turns texts into vectors. It is sent to tasks, so it must pickle."""

    model: str
    version: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingProvider:
    """A provider without a network: words (runs of letters, digits and underscores) hashed to signed buckets, at unit length. For tests and offline runs."""

    def __init__(self, dim: int = 64):
        self.model, self.version, self.dim = "hashing", "1", dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for w in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


def checked(vectors: list[list[float]], n: int, dim: int) -> list[list[float]]:
    if len(vectors) != n or any(len(v) != dim for v in vectors):
        raise ValueError(f"the provider must give {n} vectors of {dim} dimensions")
    return vectors


def embed(rows: DataFrame, provider: Provider, id_col: str, text_col: str, batch: int = 8, tries: int = 2) -> DataFrame:
    """id, embedding, embedding_model, embedding_version of every row; a batch that fails is tried again."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list[list[float]] = []
            for s in range(0, len(frame), batch):
                texts = frame[text_col].iloc[s : s + batch].fillna("").tolist()
                for left in reversed(range(tries)):
                    try:
                        found += checked(provider.embed(texts), len(texts), provider.dim)
                        break
                    except Exception:
                        if not left:
                            raise
            yield pd.DataFrame({id_col: frame[id_col], "embedding": found})

    out = rows.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, embedding array<float>")
    return out.withColumns({"embedding_model": F.lit(provider.model), "embedding_version": F.lit(provider.version)})


def missing(rows: DataFrame, done: DataFrame, provider: Provider, id_col: str) -> DataFrame:
    """Rows without an embedding of the provider's model and version."""
    mine = done.where((F.col("embedding_model") == provider.model) & (F.col("embedding_version") == provider.version))
    return rows.join(mine.select(id_col), id_col, "left_anti")


def covered(rows: DataFrame, done: DataFrame, provider: Provider, id_col: str) -> bool:
    return missing(rows, done, provider, id_col).isEmpty()
