"""Texts to vectors. A provider is built once in each worker and called with batches of texts."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Provider = Callable[[list[str]], np.ndarray]


def hashing_provider(dim: int) -> Provider:
    """Deterministic vectors from hashed words, for tests and as a stand-in without a model."""

    @lru_cache(maxsize=100_000)
    def place(word: str) -> tuple[int, float]:
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        return h % dim, 1.0 if h >> 63 else -1.0

    def f(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                j, s = place(w)
                out[i, j] += s
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.where(n > 1e-12, out / np.maximum(n, 1e-12), out)

    return f


def http_provider(url: str, headers: dict[str, str] | None = None, timeout: float = 30.0, tries: int = 3, wait: float = 0.5) -> Provider:
    """One request per batch to a service that answers with ``data[].embedding`` or ``embeddings[]``; made again, each time after
    twice the wait, where the service fails or does not answer."""

    def f(texts: list[str]) -> np.ndarray:
        body = json.dumps({"input": texts}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json", **(headers or {})})
        for n in range(tries):
            try:
                with urllib.request.urlopen(request, timeout=timeout) as r:
                    answer = json.load(r)
                break
            except urllib.error.URLError as e:
                if n + 1 == tries or getattr(e, "code", 500) < 500:  # an answer that refuses will refuse again
                    raise
                time.sleep(wait * 2**n)
        return np.array([d["embedding"] for d in answer["data"]] if "data" in answer else answer["embeddings"], float)

    return f


def embed(text: Column | str, dim: int, provider: Callable[[], Provider] | None = None, batch: int = 64, max_chars: int | None = None) -> Column:
    """A vector of floats for each text; null for null. Whole texts unless ``max_chars`` says how many signs a model takes."""
    make = provider or (lambda: hashing_provider(dim))

    @F.pandas_udf("array<float>")
    def f(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = make()
        for s in series:
            texts = s.fillna("").tolist()
            if max_chars:
                texts = [t[:max_chars] for t in texts]
            parts = [p(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            yield pd.Series([None if null else v.astype(np.float32) for null, v in zip(s.isna(), (v for part in parts for v in part))])

    return f(F.col(text) if isinstance(text, str) else text)


def dimension(provider: Provider) -> int:
    """The length of the vectors of a provider, from one text."""
    return int(np.asarray(provider(["dimension"])).shape[1])


def signature(sig: dict) -> dict:
    """What identifies a model, in one form: names of equal backends agree, a local model is known by its file name."""
    backend = str(sig.get("backend") or "").strip().lower().replace("-", "_")
    backend = "llama_cpp" if backend in ("gguf", "llama") else backend
    path = sig.get("model_path")
    path = os.path.abspath(os.path.expanduser(str(path))) if path else None
    name = str(sig.get("model_name") or "").strip()
    if backend == "llama_cpp":
        name = os.path.basename(name or path or "")
    try:
        dim = int(sig.get("dim") or 0)
    except (TypeError, ValueError):
        dim = 0
    return {"backend": backend, "model_name": name, "model_path": path, "url": str(sig.get("url") or "").strip() or None, "dim": dim}


class OtherModel(ValueError):
    """The stored vectors are of another model."""


def guard(stored: str | None, now: dict, allow: bool = False) -> str:
    """The signature to store beside vectors, as JSON; another one than the stored is refused unless ``allow``."""
    text = json.dumps(signature(now), sort_keys=True)
    if stored and not allow and json.dumps(signature(json.loads(stored)), sort_keys=True) != text:
        raise OtherModel(f"stored {stored}, now {text}")
    return text
