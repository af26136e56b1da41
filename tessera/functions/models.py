"""Model interfaces and deterministic stand-ins. The stand-ins are for tests and offline runs; they are no neural models."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .text import tokenize


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Evaluator(Protocol):
    def score(self, query: Column, text: Column) -> Column: ...


class LanguageModel(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class Similarity(Protocol):
    def score(self, a: Column, b: Column) -> Column: ...


def require_module(name: str, of: str) -> None:
    """RuntimeError if a model's library is not there; asked before a job starts, not in its tasks."""
    from importlib.util import find_spec

    if find_spec(name) is None:
        raise RuntimeError(f"{of} needs {name}")


class EmbeddingAdapter:
    """One text or a list of texts, as the caller has it; adds no prefix."""

    def __init__(self, model: Embedder):
        self.model = model

    def __call__(self, value: str | list[str]) -> list:
        if isinstance(value, str):
            return self.model.embed([value])[0].tolist()
        if isinstance(value, list) and all(isinstance(x, str) for x in value):
            return [x.tolist() for x in self.model.embed(value)]
        raise ValueError("a text or a list of texts is needed")


def masked_mean(vectors: Column, mask: Column, longest: int = 512) -> Column:
    """Mean of the token vectors (array of arrays) whose mask is not 0, of the first `longest`; null if none is."""
    both = F.slice(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] != 0), 1, longest)
    sums = F.aggregate(F.slice(both, 2, longest), F.transform(F.get(both, F.lit(0))["v"], lambda x: x.cast("double")), lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b.cast("double")))
    return F.transform(sums, lambda x: x / F.size(both))


def text_cosine(a: Column, b: Column, model: Embedder, prefixes: tuple[str, str] = ("", "")) -> Column:
    """Cosine of two texts, each embedded with its own prefix; null if one has no vector."""
    return cosine(embed(F.concat(F.lit(prefixes[0]), a), model), embed(F.concat(F.lit(prefixes[1]), b), model))


class HashingEmbedder:
    """Signed feature hashing of tokens, L2-normalised."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), self.size), np.float32)
        for row, text in zip(out, texts):
            for t in re.findall(r"\w+", (text or "").lower()):
                h = zlib.crc32(t.encode())
                row[h % self.size] += 1 if h & 0x80000000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(text: Column, model: Embedder) -> Column:
    """array<float>; the model goes to each Python worker once per task, batches come by Arrow."""

    run = F.pandas_udf(lambda s: pd.Series([x.tolist() for x in model.embed(s.fillna("").tolist())]), ArrayType(FloatType()))
    return run(text)


class OverlapEvaluator:
    """Share of the query's distinct tokens that the text holds: the stand-in for a cross-encoder."""

    def score(self, query: Column, text: Column) -> Column:
        q = F.array_distinct(tokenize(query))
        return F.round(F.size(F.array_intersect(q, tokenize(text))) / F.greatest(F.size(q), F.lit(1)), 6)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    n = F.nullif(norm(a), F.lit(0.0))
    return F.transform(a, lambda x: x.cast("double") / n)
