"""Embedders: a native keyword embedder and batched model inference."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Protocol

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import embedding_text, let
from ..schema import DEFAULT_MODEL, EMBED_BATCH


class Embedder(Protocol):
    """Turns a text column into an ARRAY<FLOAT> column; ``name`` identifies the model."""

    name: str

    def as_column(self, text: Column, batch_size: int = EMBED_BATCH) -> Column: ...


class KeywordEmbedder:
    """1 per vocabulary word that occurs in the lower-cased text, else 0; no UDF involved.

    A text without any word gets 0.01 in the last slot, so that no vector is zero.
    """

    def __init__(self, vocabulary: Iterable[str]) -> None:
        self.vocabulary = tuple(vocabulary)
        if not self.vocabulary or any("," in w for w in self.vocabulary):
            raise ValueError("a vocabulary needs words without commas")
        self.name = "keyword:" + ",".join(self.vocabulary)

    def as_column(self, text: Column, batch_size: int = EMBED_BATCH) -> Column:
        def found(lowered: Column) -> Column:
            return F.array(*[F.contains(lowered, F.lit(w)).cast("float") for w in self.vocabulary])

        nothing = F.lit([0.0] * (len(self.vocabulary) - 1) + [0.01]).cast("array<float>")
        slots = let(F.lower(text), found)
        return let(slots, lambda v: F.when(F.array_max(v) == 0, nothing).otherwise(v))


class ModelEmbedder:
    """Batched inference with a model that each Python worker loads once, when needed.

    ``load`` runs in the worker and returns ``encode(list[str]) -> (n, dim) array``. Without
    it, ``name`` is taken as a sentence-transformers model.
    """

    def __init__(
        self,
        name: str = DEFAULT_MODEL,
        load: Callable[[], Callable[[Sequence[str]], np.ndarray]] | None = None,
    ) -> None:
        self.name = name
        self._load = load

    def as_column(self, text: Column, batch_size: int = EMBED_BATCH) -> Column:
        name, load = self.name, self._load

        def make_predict() -> Callable[[np.ndarray], np.ndarray]:
            if load is not None:
                encode = load()
            else:
                from sentence_transformers import SentenceTransformer

                model = SentenceTransformer(name)

                def encode(texts: Sequence[str]) -> np.ndarray:
                    return model.encode(
                        texts, batch_size=batch_size, show_progress_bar=False, convert_to_numpy=True
                    )

            return lambda texts: np.asarray(encode(list(texts)), dtype=np.float32)

        udf = predict_batch_udf(
            make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
        )
        return udf(text)


_MODELS: dict[str, Embedder] = {}


def register_embedder(embedder: Embedder) -> Embedder:
    """Make an embedder available to indexes that were built with its name."""
    _MODELS[embedder.name] = embedder
    return embedder


def embedder_named(name: str) -> Embedder:
    """The embedder an index stores by name: registered, keyword, or a model to load."""
    if name in _MODELS:
        return _MODELS[name]
    if name.startswith("keyword:"):
        return KeywordEmbedder(name.removeprefix("keyword:").split(","))
    return ModelEmbedder(name)


def embed(
    df: DataFrame, text: str, embedder: Embedder, batch_size: int = EMBED_BATCH
) -> DataFrame:
    """Add the ``embedding`` of a text column."""
    return df.withColumn("embedding", embedder.as_column(F.col(text), batch_size))


def embed_snippets(
    snippets: DataFrame, embedder: Embedder, batch_size: int = EMBED_BATCH
) -> DataFrame:
    """Add the ``embedding`` of each snippet's language, name and content."""
    content = F.coalesce("content", F.lit(""))  # a row that stands for a file without snippets
    text = embedding_text(F.col("language"), F.col("name"), content)
    return snippets.withColumn("embedding", embedder.as_column(text, batch_size))
