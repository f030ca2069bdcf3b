"""Retrievers as objects: search(questions, n) -> (qid, key, rank, score), alone or as a weighted ensemble."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.config import DEFAULT, Config
from lexivec.operators import retrieve


class Retriever:
    """Questions are rows (qid, question) and, for dense search, (qid, question, vector)."""

    def search(self, questions: DataFrame, n: int | None = None) -> DataFrame:
        raise NotImplementedError

    def documents(self, questions: DataFrame, chunks: DataFrame, n: int | None = None) -> DataFrame:
        """The ranked list with the texts of chunks (key, text)."""
        return self.search(questions, n).join(chunks.select("key", "text"), "key")


@dataclass
class Sparse(Retriever):
    chunks: DataFrame
    config: Config = DEFAULT

    def search(self, questions: DataFrame, n: int | None = None) -> DataFrame:
        return retrieve.bm25_top(questions.select("qid", "question"), self.chunks, n, self.config)


@dataclass
class Dense(Retriever):
    vectors: DataFrame
    config: Config = DEFAULT

    def search(self, questions: DataFrame, n: int | None = None) -> DataFrame:
        return retrieve.dense_top(questions.select("qid", "vector"), self.vectors, n, self.config)


@dataclass
class Ensemble(Retriever):
    """Weighted reciprocal rank fusion of a dense and a sparse retriever."""

    dense: Retriever
    sparse: Retriever
    weights: tuple[float, float] = (0.5, 0.5)
    config: Config = field(default_factory=lambda: DEFAULT)

    def search(self, questions: DataFrame, n: int | None = None) -> DataFrame:
        fused = retrieve.rrf(self.dense.search(questions), self.sparse.search(questions), pool=n, weights=self.weights, config=self.config)
        return fused.select("qid", "key", F.col("pool_pos").alias("rank"), F.col("fused").alias("score"))
