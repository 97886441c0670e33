"""Embedding and reranking functions that can be exchanged, and a stand-in that needs no model."""

from __future__ import annotations

import json
import urllib.request
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DIM = 64
MODEL, VERSION = "hashing-64", "1"


def hashing_model() -> Callable[[list[str]], np.ndarray]:
    """Signed counts of hashed words, scaled to length 1. A stand-in for a real model."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIM), np.float32)
        for row, t in zip(out, texts):
            for word in (t or "").lower().split():
                h = zlib.crc32(word.encode())
                row[h % DIM] += 1 if h & 1 << 16 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embed


def embedder(factory: Callable = hashing_model, batch: int = 64):
    """A column function from text to vector. factory makes the model, once in each Python worker."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in parts:
            rows = [model(texts.iloc[at : at + batch].fillna("").tolist()) for at in range(0, len(texts), batch)]
            yield pd.Series([v for block in rows for v in block], dtype=object)

    return embed


def reranker(factory: Callable):
    """A column function of (question, text) to a score; factory makes a function of two lists."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for a, b in parts:
            yield pd.Series(model(a.fillna("").tolist(), b.fillna("").tolist()), dtype=float)

    return score


def http_model(url: str, batch: int = 64, timeout: float = 300.0) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A factory for embedder(): texts go to a service (POST /embed with texts and batch_size, which answers with
    embeddings in their order), which keeps one model for all workers."""

    def make() -> Callable[[list[str]], np.ndarray]:
        def embed(texts: list[str]) -> np.ndarray:
            out = []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                found = _call(f"{url.rstrip('/')}/embed", timeout, {"texts": part, "batch_size": batch})["embeddings"]
                if len(found) != len(part):
                    raise ValueError(f"{len(found)} embeddings for {len(part)} texts")
                out += found
            return np.array(out, np.float32)

        return embed

    return make


def _call(url: str, timeout: float, body: dict | None = None) -> dict:
    data = None if body is None else json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=timeout) as r:
        return json.loads(r.read())


def service_state(url: str, timeout: float = 3.0) -> dict | None:
    """What GET /health tells (status, model, dim, version); None if nobody answers."""
    try:
        return _call(f"{url.rstrip('/')}/health", timeout)
    except (OSError, ValueError):
        return None


def choose_embedder(config: dict, model: str = MODEL, version: str | None = VERSION, factory: Callable = hashing_model, batch: int = 64):
    """The service of config's embed_url if it answers and has the same model and version, else the model made by
    factory in each worker. Returns the column function and why it was chosen."""
    url = config.get("embed_url")
    state = service_state(url) if url else None
    wanted = config.get("version") or version
    if not url:
        why = "no service configured"
    elif state is None:
        why = "the service does not answer"
    elif state.get("model") != model or (wanted and state.get("version") and state["version"] != wanted):
        why = f"the service has {state.get('model')} {state.get('version')}, not {model} {wanted}"
    else:
        return embedder(http_model(url, batch), batch), f"service at {url}"
    return embedder(factory, batch), why


def prefixed(text: Column, model: str, role: str = "passage") -> Column:
    """Models of the e5 family tell questions (query) from texts (passage)."""
    return F.concat(F.lit(f"{role}: "), text) if "e5" in model.lower() else text


def query_vector(spark: SparkSession, question: str, embed, model: str = MODEL) -> list[float]:
    return list(spark.range(1).select(embed(prefixed(F.lit(question), model, "query"))).first()[0])


def check_model(config: dict, model: str, version: str | None) -> None:
    """Vectors of another model or version can't be compared."""
    for key, now in (("model", model), ("version", version)):
        if config.get(key) and now and config[key] != now:
            raise ValueError(f"the graph was embedded with {key} {config[key]!r}, not {now!r}")
