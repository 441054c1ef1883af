"""Plug-in points: names to embedders, rerankers, splitters and chat models, with offline ones built in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import index_terms, refine
from quarry.operators import chunks, evaluation, rerank
from quarry.sources import files, sinks


class Registry:
    """Plug-ins of one kind by lower-case name."""

    def __init__(self, kind: str):
        self.kind, self.known = kind, {}

    def register(self, name: str, plugin: Callable) -> None:
        if not callable(plugin):
            raise TypeError(f"{self.kind} {name!r} can't be called")
        self.known[name.strip().lower()] = plugin

    def create(self, name: str) -> Callable:
        try:
            return self.known[name.strip().lower()]
        except KeyError:
            raise ValueError(f"unknown {self.kind} {name!r}; there are: {', '.join(sorted(self.known)) or 'none'}") from None


def hashing_embedder(dims: int = 64) -> Callable[[Column], Column]:
    """An offline embedder: signed counts of hashed terms, of unit length; a text without terms is the zero vector."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        place: dict[str, tuple[int, int]] = {}
        for terms in batches:
            out = []
            for row in terms:
                v = np.zeros(dims)
                for t in row if row is not None else ():
                    if t not in place:
                        if len(place) >= 1 << 16:
                            place.clear()
                        h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
                        place[t] = h % dims, 1 if h >> 63 else -1
                    i, sign = place[t]
                    v[i] += sign
                size = np.sqrt(v @ v)
                out.append((v / size if size else v).astype(np.float32))
            yield pd.Series(out)

    return lambda text: embed(index_terms(text))


embedders, rerankers, splitters, chats, evaluators, visions, transforms, stores, benchmarks, segmenters = (
    Registry(k) for k in ("embedder", "reranker", "splitter", "chat model", "evaluator", "vision model", "transform", "vector store", "benchmark", "segmenter")
)
embedders.register("hashing", hashing_embedder)
rerankers.register("none", lambda query, text: F.lit(None).cast("double"))
rerankers.register("overlap", rerank.overlap_score)
splitters.register("window", chunks.windows)
splitters.register("recursive", chunks.recursive)
transforms.register("refine", lambda body: refine(body))
transforms.register("none", lambda body: body)
evaluators.register("benchmark", evaluation.benchmark_evaluator)
evaluators.register("custom", lambda names: evaluation.custom_evaluator([n for n in names if n in ("hit_rate", "mrr")] or ("hit_rate", "mrr")))
evaluators.register("none", lambda names: evaluation.no_evaluator)
segmenters.register("none", lambda words: words)
chats.register("first-texts", lambda prompt: prompt)
visions.register("none", lambda content: F.lit(None).cast("string"))
stores.register("parquet", sinks.open_vectors)
benchmarks.register("jsonl", files.benchmark_file)
