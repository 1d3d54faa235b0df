"""Model plug-ins: embedders, scorers, metrics and classifiers, with offline defaults that need no model."""

from __future__ import annotations

import difflib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS: dict[str, Callable[[str, str], float]] = {}


def hash_embedder(size: int) -> Callable[[list[str]], np.ndarray]:
    """Signed hashed words, unit length: the same text has the same vector anywhere."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for row, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
                out[row, h % size] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return run


def embed(size: int = 64, embedder: Callable[[list[str]], np.ndarray] | None = None):
    """A function from a text column to vectors, batch by batch."""
    run = embedder or hash_embedder(size)

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(run(texts.fillna("").tolist()).astype(np.float32)))

    return vectors


def self_check(embedder: Callable[[list[str]], np.ndarray], margin: float = 0.10) -> bool:
    """Finite vectors, and two related texts closer than an unrelated one by the margin."""
    a, b, c = embedder(["how to plan a product launch", "plan for a product launch", "rain over distant mountains"])
    return bool(np.isfinite([a, b, c]).all() and a @ b - a @ c >= margin)


def metric(name: str):
    """Registers a metric of two texts, 0 to 1, under a name."""

    def add(f: Callable[[str, str], float]) -> Callable[[str, str], float]:
        METRICS[name] = f
        return f

    return add


@metric("exact")
def similarity_ratio(expected: str, got: str) -> float:
    norm = lambda s: " ".join((s or "").lower().split())
    return difflib.SequenceMatcher(None, norm(expected), norm(got)).ratio()


@metric("judge")
def offline_judge(expected: str, got: str) -> float:
    """The stand-in for a judging model: shared words out of all, clamped to 0 to 1."""
    a, b = set((expected or "").lower().split()), set((got or "").lower().split())
    return max(0.0, min(1.0, len(a & b) / len(a | b))) if a | b else 0.0


def score_metric(name: str, expected: Column | str, got: Column | str) -> Column:
    """The metric over rows; one that raises scores 0."""
    run = METRICS[name]

    @F.pandas_udf("double")
    def rows(a: pd.Series, b: pd.Series) -> pd.Series:
        def safe(x, y) -> float:
            try:
                return float(run(x, y))
            except (TypeError, ValueError):
                return 0.0

        return pd.Series([safe(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return rows(expected, got)
