"""Embedding providers: a built-in hash embedder, and an interface for models."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemospark.functions.text import Terms, tokenize
from mnemospark.shipping import ship


class Provider(Protocol):
    """Anything with an identity that embeds lists of texts inside an executor."""

    model: str
    provider: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class _Buckets(dict):
    """term -> its number; two buckets and signs a term, kept within a fixed bound."""

    LIMIT = 200_000

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions, self.at, self.sign = dimensions, [], []

    def __missing__(self, term: str) -> int:
        digest = hashlib.sha1(term.encode()).digest()
        self.at.append([int.from_bytes(digest[4 * i : 4 * i + 4]) % self.dimensions for i in (0, 1)])
        self.sign.append([-1.0 if digest[8 + i] & 1 else 1.0 for i in (0, 1)])
        n = self[term] = len(self.at) - 1
        return n

    def vector(self, terms: list[str]) -> np.ndarray:
        counts = Counter(terms)
        numbers = [self[t] for t in counts]
        weight = 1 + np.log(np.fromiter(counts.values(), float, len(counts)))
        at = np.array([self.at[n] for n in numbers])
        sign = np.array([self.sign[n] for n in numbers])
        out = np.bincount(at.ravel(), (sign * weight[:, None]).ravel(), self.dimensions)
        return out / (np.linalg.norm(out) or 1.0)


class HashEmbedder:
    """Feature hashing of terms: a stand-in without meaning, for tests and offline use."""

    model, provider = "hashed-token-features", "hash"

    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        known, buckets, out = Terms(), _Buckets(self.dimensions), []
        for text in texts:
            if len(buckets) > buckets.LIMIT:
                buckets = _Buckets(self.dimensions)
            terms = tokenize(text, known)
            out.append(buckets.vector(terms).tolist() if terms else [0.0] * self.dimensions)
        return out


def embed_column(df: DataFrame, key: str, text: str, provider: Provider, batch: int = 1024) -> DataFrame:
    """(key, embedding, model, dims, provider) of each row."""
    ship(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, batch):
                part = whole.slice(s, batch)
                vectors = provider.embed([t or "" for t in part.column(1).to_pylist()])
                if any(len(v) != provider.dimensions for v in vectors):
                    raise ValueError("the provider's vectors are not as wide as it says")
                n = len(vectors)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array([provider.model] * n),
                        pa.array([provider.dimensions] * n, pa.int64()), pa.array([provider.provider] * n),
                    ],
                    names=[key, "embedding", "model", "dims", "provider"],
                )

    schema = f"{key} {kind}, embedding array<float>, model string, dims long, provider string"
    return df.select(key, text).mapInArrow(run, schema)
