"""Text embedding as a batched Arrow UDF with a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from runtime_insights import schema as S
from runtime_insights.functions.fields import is_blank, stripped as stripped_text

HASH_BASE, HASH_MODULUS = 257, 1_000_003


class Embedder(Protocol):
    """Makes unit-length vectors, one row per text. Texts are never blank.

    One that also has ``column(text)`` gives the vectors as a column expression.
    """

    batch_size: int

    def load(self) -> None:
        """Called once per task before the first batch."""

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class NgramEmbedder:
    """Deterministic vectors of hashed character n-grams; needs no model.

    A gram's hash is a polynomial of its code points, begun with its length. ``column`` says
    the same in built-in functions, so ``embed`` needs no Python; ``encode`` is for callers
    that have the texts themselves.
    """

    def __init__(self, size: int = 128, lengths: Sequence[int] = (2, 3), batch_size: int = 1024):
        self.size, self.lengths, self.batch_size = size, tuple(lengths), batch_size

    def load(self) -> None:
        pass

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, text in enumerate(texts):
            codes = np.array([ord(c) for c in f" {text} "], dtype=np.int64)
            for n in self.lengths:
                n = min(n, len(codes))
                grams = np.full(len(codes) - n + 1, n, np.int64)
                for i in range(n):
                    grams = (grams * HASH_BASE + codes[i : len(codes) - n + 1 + i]) % HASH_MODULUS
                np.add.at(out[row], grams % self.size, 1.0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def column(self, text: Column) -> Column:
        """The vector of a text without white space around it, in the JVM."""
        padded = F.concat(F.lit(" "), text, F.lit(" "))
        codes = F.transform(F.sequence(F.lit(1), F.length(padded)), lambda i: F.ascii(F.substring(padded, i, F.lit(1))))

        def grams(codes: Column, n: int) -> Column:
            size = F.least(F.lit(n), F.size(codes))
            return F.transform(
                F.sequence(F.lit(1), F.size(codes) - size + 1),
                lambda i: F.aggregate(
                    F.slice(codes, i, size), size.cast("bigint"),
                    lambda h, c: (h * HASH_BASE + c) % HASH_MODULUS,
                ) % self.size,
            )

        places = let(codes, lambda c: F.concat(*[grams(c, n) for n in self.lengths]))
        counted = let(places, lambda found: F.transform(
            F.sequence(F.lit(0), F.lit(self.size - 1)),
            lambda place: F.size(F.filter(found, lambda x: x == place)).cast("double"),
        ))
        return normalized(counted).cast("array<float>")


class SentenceModelEmbedder:
    """A sentence-transformers model, where that package and the model are installed."""

    def __init__(
        self, model: str, batch_size: int = S.ENCODE_BATCH,
        max_length: int = S.ENCODE_MAX_LENGTH, device: str | None = None,
    ):
        self.model, self.batch_size = model, batch_size
        self.max_length, self.device = max_length, device
        self._loaded = None

    def load(self) -> None:
        from sentence_transformers import SentenceTransformer

        self._loaded = SentenceTransformer(self.model, device=self.device)
        self._loaded.max_seq_length = self.max_length

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        return self._loaded.encode(
            list(texts), batch_size=self.batch_size, normalize_embeddings=True
        )


def embed(embedder: Embedder, text: Column) -> Column:
    """Vector of the stripped text; null for blank text, which matches nothing."""
    if hasattr(embedder, "column"):
        return embedder.column(stripped_text(text))

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder.load()
        for texts in batches:
            stripped = texts.str.strip().tolist()
            vectors: list = []
            for start in range(0, len(stripped), embedder.batch_size):
                vectors.extend(embedder.encode(stripped[start:start + embedder.batch_size]))
            yield pd.Series([np.asarray(v, dtype=np.float32) for v in vectors], dtype=object)

    return encode(text)


def text_vectors(texts: DataFrame, column: str, embedder: Embedder) -> DataFrame:
    """(text, vector) of the distinct texts that are not blank: each is encoded once."""
    distinct = texts.select(F.col(column).alias("text")).distinct()
    return distinct.filter(~is_blank(F.col("text"))).select(
        "text", embed(embedder, F.col("text")).alias("vector")
    )


def normalized(vector: Column) -> Column:
    """Unit-length vector, in the JVM."""
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return let(vector.cast("array<double>"), lambda v: let(
        length(v), lambda n: F.transform(v, lambda x: x / F.greatest(n, F.lit(1e-9)))
    ))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value made once however often it is used."""
    return F.transform(F.array(value), use)[0]


def mean_pooled(vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1 (array of arrays to one array)."""
    kept = F.filter(
        F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda t: t["m"] == 1
    )
    total = F.aggregate(
        F.transform(kept, lambda t: t["v"].cast("array<double>")),
        F.transform(vectors[0].cast("array<double>"), lambda _: F.lit(0.0)),
        lambda a, v: F.zip_with(a, v, lambda x, y: x + y),
    )
    return F.transform(total, lambda x: x / F.greatest(F.size(kept).cast("double"), F.lit(1e-9)))
