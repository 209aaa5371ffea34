"""Embedding of texts inside tasks; the model is pluggable."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlmill.functions.text import embedding_text

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = 64, normalise: bool = True) -> Embedder:
    """A deterministic stand-in for a model: signed hashed word counts."""
    import xxhash

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word)
                out[i, h % dim] += 1 if h >> 63 else -1
        if normalise:
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        return out

    return embed


def first_that_loads(factories: Sequence[Callable[[], Embedder]]) -> Embedder:
    """The embedder of the first factory that works; a repeated one is tried once."""
    last: Exception | None = None
    for make in dict.fromkeys(factories):
        try:
            return make()
        except Exception as e:  # noqa: BLE001
            last = e
    raise RuntimeError("no embedder could be loaded") from last


def in_shrinking_batches(embed: Embedder, size: int = 1024, floor: int = 16) -> Embedder:
    """``embed`` in batches that are halved when memory runs out, down to ``floor``; the size found is kept."""
    state = {"size": size}

    def run(texts: list[str]) -> np.ndarray:
        out, i = [], 0
        while i < len(texts):
            try:
                out.append(embed(texts[i : i + state["size"]]))
                i += state["size"]
            except MemoryError:
                if state["size"] <= floor:
                    raise
                state["size"] = max(floor, state["size"] // 2)
        return np.concatenate(out) if out else np.zeros((0, 0), np.float32)

    return run


def embedded(docs: DataFrame, factories: Sequence[Callable[[], Embedder]] = (hashing_embedder,), text: str = "summary") -> DataFrame:
    """(id, vector) of each row's text. The model loads once per task; texts are read in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = in_shrinking_batches(first_that_loads(factories))
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "vector": list(embed(pdf["text"].tolist()))})

    return docs.where(F.col(text).isNotNull()).select("id", embedding_text(F.col(text)).alias("text")).mapInPandas(run, "id long, vector array<float>")
