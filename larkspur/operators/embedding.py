"""Embedding providers: what turns chunks and queries into vectors, loaded once a Python worker.

A provider is any object with the attributes of ``Provider``; ``embedded`` takes a function that makes one, so that the
model itself is never sent from the driver. ``HashedProjection`` is a provider without a model: letter n-grams hashed into
buckets, their damped counts projected on fixed random signs, to unit length. Texts that share words or parts of
words are near each other; it knows nothing of meaning.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Provider(Protocol):
    provider_id: str
    model_id: str
    model_revision: str
    dimension: int
    distance_metric: str

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


def identity(provider: Provider, **more: str | int) -> dict[str, str | int]:
    """What vectors depend on: those of another identity are not comparable."""
    own = {k: getattr(provider, k) for k in ("provider_id", "model_id", "model_revision", "dimension", "distance_metric")}
    return own | more


def identity_digest(about: dict[str, str | int]) -> str:
    return hashlib.sha256(json.dumps(about, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


class HashedProjection:
    provider_id, model_id, model_revision, distance_metric = "hashed-projection", "letter-grams", "1", "cosine"

    def __init__(self, dimension: int = 128, buckets: int = 4096, gram: int = 4, seed: int = 20_240_501) -> None:
        self.dimension, self.buckets, self.gram = dimension, buckets, gram
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0], dtype=np.float32), (buckets, dimension))

    def counts(self, texts: Sequence[str]) -> np.ndarray:
        """How often each bucket's n-grams of UTF-8 bytes occur in each text, words set apart by single blanks."""
        raw = [f" {' '.join(t.lower().split())} ".encode() for t in texts]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw) + b"\0" * self.gram, dtype=np.uint8).astype(np.uint64)
        n = len(data) - self.gram
        grams = np.zeros(n, dtype=np.uint64)
        for k in range(self.gram):
            grams = grams * np.uint64(257) + data[k : n + k]
        row = np.repeat(np.arange(len(raw)), sizes)
        inside = np.arange(n) + self.gram <= np.repeat(np.cumsum(sizes), sizes)
        place = (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(self.buckets)
        at = row[inside] * self.buckets + place[inside].astype(np.int64)
        return np.bincount(at, minlength=len(raw) * self.buckets).reshape(len(raw), self.buckets)

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), dtype=np.float32)
        for begin in range(0, len(texts), 256):
            part = np.log1p(self.counts(texts[begin : begin + 256])).astype(np.float32) @ self.signs
            length = np.sqrt(np.einsum("ij,ij->i", part, part, dtype=np.float64))
            some = length > 0
            out[begin : begin + 256][some] = part[some] / length[some, None]
        return out


_LOADED: dict[Callable[[], Provider], Provider] = {}


def loaded(make: Callable[[], Provider]) -> Provider:
    """The worker's own instance of a provider; the last one made is kept."""
    if make not in _LOADED:
        _LOADED.clear()
        _LOADED[make] = make()
    return _LOADED[make]


def embedded(texts: DataFrame, column: str, make: Callable[[], Provider] = HashedProjection, out: str = "embedding") -> DataFrame:
    """texts with the vector of a column; a null text is empty. A vector of another length than the provider's
    dimension, or one that is not finite, is an error, as everything compared with it would be wrong."""

    names = [c for c in texts.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = loaded(make)
        for batch in batches:
            said = batch.column(batch.schema.get_field_index(column)).to_pylist()
            made = np.asarray(provider.embed(["" if t is None else t for t in said]), dtype=np.float32)
            if made.shape != (len(said), provider.dimension) or not np.isfinite(made).all():
                raise ValueError(f"{provider.provider_id} must give {len(said)} finite vectors of {provider.dimension}")
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(made.reshape(-1)), provider.dimension).cast(pa.list_(pa.float32()))
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in names), vectors], names=[*names, out])

    schema = T.StructType([*texts.select(*names).schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    return texts.mapInArrow(run, schema)
