"""Pluggable models (M1-M3). No weights are at hand, so the defaults are deterministic stand-ins:
hashed character trigrams to embed, word overlap to rerank, truncation to summarise. Any object of
the same shape may replace them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F

from .payload import by_steps

DIMENSIONS = 384


@lru_cache(maxsize=100_000)
def _hash(gram: str) -> int:
    return int.from_bytes(hashlib.blake2b(gram.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class HashEmbedder:
    """Texts to unit vectors; equal texts get equal vectors, no texts an empty list."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        out = [0.0] * self.dimensions
        padded = f"  {text.lower()}  "
        for i in range(len(padded) - 2):
            h = _hash(padded[i : i + 3])
            out[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in out)) or 1.0
        return [x / norm for x in out]


class OverlapReranker:
    """A logit per document: the share of the query's words that it has."""

    def score(self, query: str, docs: Sequence[str]) -> list[float]:
        words = set(query.lower().split())
        return [8.0 * len(words & set((d or "").lower().split())) / len(words) - 4.0 if words else 0.0 for d in docs]


def embed_udf(embedder) -> Callable:
    """M1 as an Arrow UDF."""

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        return by_steps(lambda some: embedder.embed([x or "" for x in some]), pa.list_(pa.float32()), texts)

    return embed


def rerank_udf(reranker) -> Callable:
    """M2 as an Arrow UDF over (query, document)."""

    @F.arrow_udf("double")
    def rerank(query: pa.Array, docs: pa.Array) -> pa.Array:
        return by_steps(lambda asked, some: [reranker.score(q, [d])[0] for q, d in zip(asked, some)], pa.float64(), query, docs)

    return rerank
