"""Where models are called.  Every provider is replaceable; the ones here work offline and always give the same answer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Provider(Protocol):
    """Texts to vectors, pairs to scores, prompts to answers; each in batches."""

    def embed(self, texts: list[str]) -> np.ndarray: ...

    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...

    def answer(self, prompts: list[str]) -> list[str]: ...


def last_token(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The state of each row's last token that counts, wherever the padding is."""
    if mask[:, -1].all():
        return states[:, -1]
    return states[np.arange(len(states)), mask.sum(axis=1) - 1]


class Offline:
    """Vectors from hashed words, scores from their cosine, answers that repeat the start of the prompt's last paragraph."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for i, text in enumerate(texts):
            for word in re.findall(r"\w+", (text or "").lower()):
                h = 1469598103934665603
                for byte in word.encode():
                    h = ((h ^ byte) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
                out[i, h % self.size] += 1.0 if h >> 63 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1.0)

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        a, b = self.embed([x for x, _ in pairs]), self.embed([y for _, y in pairs])
        return np.einsum("ij,ij->i", a, b).tolist() if pairs else []

    def answer(self, prompts: list[str]) -> list[str]:
        return [" ".join((p or "").rstrip().rsplit("\n\n", 1)[-1].split()[:40]) for p in prompts]


def embedded(text: Column, provider: Provider | None = None) -> Column:
    provider = provider or Offline()

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series([None if t is None else v.tolist() for t, v in zip(s, provider.embed([t or "" for t in s]))])

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(text)


def scored(query: Column, text: Column, provider: Provider | None = None, failed: float = 4.0) -> Column:
    """Relevance of each pair; a batch whose model fails scores ``failed`` for all."""
    provider = provider or Offline()

    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in it:
            try:
                yield pd.Series(provider.score(list(zip(q.fillna(""), t.fillna("")))), dtype="float64")
            except Exception:  # noqa: BLE001 - whatever the model raised
                yield pd.Series([failed] * len(q), dtype="float64")

    run.__annotations__ = {"it": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(query, text)


def answered(prompt: Column, provider: Provider | None = None) -> Column:
    provider = provider or Offline()

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series([None if p is None else a for p, a in zip(s, provider.answer([p or "" for p in s]))])

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(prompt)
