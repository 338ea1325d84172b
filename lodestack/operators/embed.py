"""Encoders. A model plugs in as a function from texts to a matrix; the built-in one hashes
word n-grams by md5 and needs no model file."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 64


@dataclass(frozen=True)
class Encoder:
    """``make()`` is called once per worker and gives texts -> float matrix. The prefix of
    queries is ``query: `` for models of the e5 family, none for others, unless given."""

    name: str
    make: Callable[[], Callable[[list[str]], np.ndarray]]
    query_prefix: str | None = None
    passage_prefix: str = ""

    @property
    def for_queries(self) -> str:
        return self.query_prefix if self.query_prefix is not None else "query: " if "e5" in self.name.lower() else ""


def hashing(ngram: int = 1, dim: int = DIM) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Signed counts of word n-grams: bucket and sign come from the n-gram's md5."""

    def make() -> Callable[[list[str]], np.ndarray]:
        memo: dict[str, tuple[int, int]] = {}

        def place(gram: str) -> tuple[int, int]:
            if (got := memo.get(gram)) is None:
                if len(memo) > 500_000:
                    memo.clear()
                h = hashlib.md5(gram.encode()).hexdigest()
                got = memo[gram] = int(h[:8], 16) % dim, 1 - 2 * (int(h[8], 16) % 2)
            return got

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for row, t in zip(out, texts, strict=True):
                words = (t or "").lower().split()
                grams = words if ngram == 1 else [" ".join(words[i : i + ngram]) for i in range(len(words) - ngram + 1)]
                for g in grams:
                    at, sign = place(g)
                    row[at] += sign
            return out

        return encode

    return make


_MADE: dict[str, Callable] = {}


def encode_column(text: Column, encoder: Encoder) -> Column:
    name, make = encoder.name, encoder.make

    @F.arrow_udf("array<float>")
    def of(texts: pa.Array) -> pa.Array:
        if name not in _MADE:
            _MADE[name] = make()
        m = _MADE[name](texts.to_pylist())
        return pa.array(list(m.astype(np.float32)), pa.list_(pa.float32()))

    return of(text)


def embed(df: DataFrame, encoder: Encoder, text: str, id_col: str, query: bool = False, limit: int | None = None) -> DataFrame:
    """``id_col, encoder, embedding``; ``limit`` takes the first rows in id order."""
    if limit:
        df = df.orderBy(id_col).limit(limit)
    prefix = encoder.for_queries if query else encoder.passage_prefix
    return df.select(id_col, F.lit(encoder.name).alias("encoder"), encode_column(F.concat(F.lit(prefix), F.coalesce(text, F.lit(""))), encoder).alias("embedding"))


def hash_encoders(dim: int = DIM) -> list[Encoder]:
    return [Encoder("hash-words", hashing(1, dim)), Encoder("hash-e5-pairs", hashing(2, dim))]
