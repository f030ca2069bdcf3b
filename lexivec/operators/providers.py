"""Interfaces to models, and defaults that need none."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.functions import text as T

#: What a retrieval model expects before a question.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = 64) -> Embedder:
    """Signed counts of hashed words, of unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, t in zip(out, texts, strict=True):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                row[h % dim] += 1 if h & 0x80000000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embed(df: DataFrame, text: str, into: str, load: Callable[[], Embedder], prefix: str = "") -> DataFrame:
    """df with an embedding; load() runs once in each worker, however many batches it gets."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(list(model([prefix + t for t in batch])))

    return df.withColumn(into, run(F.coalesce(text, F.lit(""))))


def extractive_answer(chunks: str = "chunks"):
    """The first sentence of the best chunk with its id as citation, or the sentence that abstains."""
    best = F.get(F.col(chunks), F.lit(0))
    sentence = F.regexp_extract(best["text"], r"(?s)^\s*(.+?[.!?])(?:\s|$)", 1)
    return F.when(best.isNull() | (sentence == ""), T.ABSTAIN_SENTENCE).otherwise(F.concat(sentence, F.lit(" ["), best["chunk_id"], F.lit("]")))


def extractive(model: str, **options) -> Callable[[DataFrame], DataFrame]:
    """The provider that needs no model: rows (chunks, ...) with a text."""
    return lambda rows: rows.withColumn("text", extractive_answer())


#: Makers of providers by name: maker(model, **options) gives a function from rows (question, chunks, ...) to rows with text.
CHAT_PROVIDERS: dict[str, Callable[..., Callable[[DataFrame], DataFrame]]] = {"extractive": extractive}


def chat_model(provider: str, model: str, **options):
    """A registered provider's function; an unknown name is an error."""
    if provider not in CHAT_PROVIDERS:
        raise ValueError(f"unknown provider {provider!r}; known: {sorted(CHAT_PROVIDERS)}")
    return CHAT_PROVIDERS[provider](model, **options)
