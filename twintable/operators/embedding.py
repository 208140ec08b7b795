"""Text to vector: providers and their distributed application."""

from __future__ import annotations

import importlib
import re
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EmbeddingProvider(ABC):
    """Turns a batch of texts into vectors of ``dimension`` numbers. Runs in the executors, so it must pickle."""

    dimension: int

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray: ...


class SeededGaussian(EmbeddingProvider):
    """A unit vector drawn with the text's hash as seed: equal texts match, others are nearly orthogonal."""

    def __init__(self, dimension: int = 128):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        x = np.stack([np.random.default_rng(xxhash.xxh64_intdigest(t)).standard_normal(self.dimension) for t in texts])
        return x / np.linalg.norm(x, axis=1, keepdims=True)


class TokenHashing(EmbeddingProvider):
    """Signed counts of hashed name parts and types, as unit vectors: texts with like columns are alike."""

    def __init__(self, dimension: int = 128):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            for token in re.findall(r"[^\W_]+", text.lower()):
                h = xxhash.xxh64_intdigest(token)
                row[h % self.dimension] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


class Endpoint(EmbeddingProvider):
    """A hosted model behind ``call(texts) -> vectors``, in batches; the caller brings the client and its key."""

    def __init__(self, call: Callable[[list[str]], list[list[float]]], dimension: int, batch: int = 16):
        if call is None:
            raise ValueError("a hosted provider needs a client")
        self.call, self.dimension, self.batch = call, dimension, batch

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([v for i in range(0, len(texts), self.batch) for v in self.call(texts[i : i + self.batch])], float)


class LocalModel(EmbeddingProvider):
    """A locally installed sentence model, loaded on first use in each worker; needs its library there."""

    def __init__(self, model: str, dimension: int = 384, batch: int = 32):
        self.model, self.dimension, self.batch, self._loaded = model, dimension, batch, None

    def embed(self, texts: list[str]) -> np.ndarray:
        if self._loaded is None:
            self._loaded = importlib.import_module("sentence_transformers").SentenceTransformer(self.model)
        return np.asarray(self._loaded.encode(texts, batch_size=self.batch, normalize_embeddings=True))


def provider(name: str, **options) -> EmbeddingProvider:
    """A provider by name, in any case: simple, hashing, endpoint, remote, local."""
    kinds = {"simple": SeededGaussian, "hashing": TokenHashing, "endpoint": Endpoint, "remote": Endpoint, "local": LocalModel}
    if name.lower() not in kinds:
        raise ValueError(f"unknown embedding provider: {name}")
    return kinds[name.lower()](**options)


def embed_texts(df: DataFrame, text: str, by: EmbeddingProvider, out: str = "embedding") -> DataFrame:
    """``df`` with the vector of a text column; a null text has a null vector. Arrow batches, no driver involved."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            has = s.notna()
            got = iter(by.embed(s[has].tolist())) if has.any() else iter(())
            yield pd.Series([next(got) if h else None for h in has], dtype=object)

    return df.withColumn(out, vectors(text))


def embed_schema_texts(df: DataFrame, by: EmbeddingProvider) -> DataFrame:
    return embed_texts(df.select("full_table_name", "schema_text"), "schema_text", by)


def embed_columns(df: DataFrame, by: EmbeddingProvider) -> DataFrame:
    """Vectors of the rows of ``column_texts``."""
    return embed_texts(df.select("full_table_name", "column_name", "data_type", "comment", "column_text"), "column_text", by)
