"""Embedding providers: text column in, unit-vector column out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

from ..session import bounded_batches

DIMENSION = 768  # Fixed value: dimension of the vector collection.


class EmbeddingProvider(Protocol):
    name: str
    dimension: int

    def embed(self, content: Column) -> Column: ...


def words(content: Column) -> Column:
    parts = F.split(F.lower(content), r"[^\p{IsAlphabetic}\p{N}]+", -1)
    return F.filter(parts, lambda x: x != "")


def word_number(word: str) -> int:
    """First 32 bits of the word's MD5."""
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big")


def _bounded() -> None:
    """Texts go to Python in bounded batches, also where no operator has seen to that."""
    session = SparkSession.getActiveSession()
    if session is not None:
        bounded_batches(session)


class HashedEmbedding:
    """Signed feature hashing of words, scaled to unit length.

    It stands where a neural model would be plugged in: deterministic, any
    dimension, texts that share words are near each other.  Spark cuts the
    words; each Arrow batch is dictionary-encoded, so a word is hashed once
    per batch at most, and summed as one matrix.
    """

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension
        self.name = f"hashed-words-{dimension}"

    def embed(self, content: Column) -> Column:
        _bounded()
        dimension = self.dimension

        @F.arrow_udf("array<float>")
        def accumulate(batch: pa.Array) -> pa.Array:
            if isinstance(batch, pa.ChunkedArray):
                batch = batch.combine_chunks()
            n = len(batch)
            found = batch.flatten().dictionary_encode()
            number = np.array([word_number(w) for w in found.dictionary.to_pylist()], dtype=np.int64) % (2 * dimension)
            feature = number[found.indices.to_numpy()]
            row = np.repeat(np.arange(n), np.diff(batch.offsets.to_numpy()))
            sums = np.bincount(row * dimension + feature // 2, weights=1.0 - 2.0 * (feature % 2),
                               minlength=n * dimension).reshape(n, dimension)
            norm = np.sqrt(np.einsum("ij,ij->i", sums, sums))
            unit = sums / np.where(norm > 0, norm, 1.0)[:, None]
            offsets = np.arange(0, (n + 1) * dimension, dimension, dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.astype(np.float32).ravel()))

        return accumulate(F.coalesce(words(content), F.expr("cast(array() as array<string>)")))


class ModelEmbedding:
    """A real model: `load()` runs once per Python worker and returns texts -> matrix."""

    def __init__(self, name: str, dimension: int, load: Callable[[], Callable[[list[str]], np.ndarray]]):
        self.name, self.dimension, self._load = name, dimension, load

    def embed(self, content: Column) -> Column:
        _bounded()
        load = self._load

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for batch in batches:
                out = np.asarray(model(batch.fillna("").tolist()), dtype=np.float64).reshape(len(batch), -1)
                norm = np.linalg.norm(out, axis=1, keepdims=True)
                yield pd.Series(list((out / np.where(norm > 0, norm, 1.0)).astype(np.float32)))

        return run(content)


def embed_text(spark: SparkSession, provider: EmbeddingProvider, text: str) -> list[float]:
    """Vector of one request text."""
    row = spark.range(1).select(provider.embed(F.lit(text)).alias("v")).first()
    return [float(x) for x in row["v"]]
