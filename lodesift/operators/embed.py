"""Batched embedding of document and query tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from ..config import EmbeddingConfig
from ..functions.text import TOKEN


class Encoder(Protocol):
    """What a model has to offer; it is pickled to the tasks.

    Load weights lazily in ``encode`` and keep them in a module of their own,
    so that each Python worker loads them once.
    """

    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class _Slots(dict):
    """Token to ``2 * bucket + (1 if negative)``, filled on first use."""

    limit = 500_000             # tokens remembered per task

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        digest = hashlib.md5(token.encode()).hexdigest()
        slot = int(digest[:8], 16) % self.dim * 2 + int(digest[8], 16) % 2
        if len(self) < self.limit:
            self[token] = slot
        return slot


class HashedEncoder:
    """Signed feature hashing of tokens, L2-normalised: the default model.

    Bucket and sign of a token come from its MD5, so any engine can repeat it:
    the first eight hex digits modulo ``dim``, and the parity of the ninth.
    """

    def __init__(self, dim: int = EmbeddingConfig.dim):
        self.dim = dim
        self._token = re.compile(TOKEN)
        self._slots: _Slots | None = None

    def encode(self, texts: list[str]) -> np.ndarray:
        if self._slots is None:
            self._slots = _Slots(self.dim)
        lists = [self._token.findall(text.lower()) for text in texts]
        lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        slots = np.fromiter(
            map(self._slots.__getitem__, chain.from_iterable(lists)), dtype=np.int64, count=int(lengths.sum())
        )
        flat = np.repeat(np.arange(len(texts)) * self.dim, lengths) + (slots >> 1)
        counts = np.bincount(flat, weights=1.0 - 2.0 * (slots & 1), minlength=len(texts) * self.dim)
        vectors = counts.astype(np.float64).reshape(len(texts), self.dim)
        norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def embed(
    df: DataFrame, encoder: Encoder | None = None, text_col: str = "text", out: str = "embedding",
    batch_rows: int = EmbeddingConfig.batch_rows,
) -> DataFrame:
    """Add an ``array<float>`` column, one vector per row, rows in place.

    A narrow transformation: no shuffle, texts go to Python in Arrow batches
    and reach the model in groups of at most ``batch_rows``.
    """
    encoder = encoder or HashedEncoder()
    position = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                texts = [t or "" for t in part.column(position).to_pylist()]
                vectors = np.ascontiguousarray(encoder.encode(texts), dtype=np.float32)
                offsets = np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, column], names=[*part.schema.names, out]
                )

    return df.mapInArrow(run, schema)
