"""Embedders: anything that turns texts into vectors of one length.

HashingEmbedder is a stand-in that needs no model: signed hashed tokens, unit length. It finds
passages that share words; it claims nothing about meaning.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake.functions.tokens import tokens_of


class Embedder(Protocol):
    name: str
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    def __init__(self, dimensions: int = 384):
        self.dimensions, self.name = dimensions, f"hashing-{dimensions}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for t in tokens_of(text):
                h = zlib.crc32(t.encode())
                row[h % self.dimensions] += 1 if h >> 31 else -1
            if not row.any():
                row[0] = 1
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def problem(v: np.ndarray | None, dimensions: int) -> str | None:
    if v is None or len(v) != dimensions:
        return "wrong length"
    if not np.isfinite(v).all():
        return "not finite"
    return None if v.any() else "all zero"


def embedded(passages: DataFrame, embedder: Embedder, text: str = "embed_text") -> DataFrame:
    """(key, n, vector): one call for each Arrow batch; a bad vector is tried once more, then null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["text"].fillna("").tolist()
            got = list(embedder.embed(texts)) if texts else []
            for i, v in enumerate(got):
                if problem(v, embedder.dimensions):
                    again = embedder.embed([texts[i]])[0]
                    got[i] = None if problem(again, embedder.dimensions) else again
            yield pd.DataFrame({"key": f["key"], "n": f["n"], "vector": got})

    return passages.select("key", "n", F.col(text).alias("text")).mapInPandas(run, "key string, n int, vector array<float>")
