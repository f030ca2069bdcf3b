"""Settings with their defaults; each can be set by an environment variable LEXIVEC_<NAME>."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    chunk_strategy: str = "recursive"
    chunk_tokens: int = 512
    chunk_overlap: float = 0.12
    min_chunk_tokens: int = 5
    dense_top_n: int = 50
    sparse_top_n: int = 50
    rrf_k: int = 60
    rerank_top_k: int = 5
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    faithfulness_threshold: float = 0.80
    ci_subset_size: int = 10
    ci_min_items: int = 6
    low_score: float = 0.60
    retrieval_fail_recall: float = 0.50
    rate_limit: int = 20
    max_retries: int = 15
    backoff_base: float = 2.0
    backoff_cap: float = 65.0
    call_timeout: float = 90.0
    item_timeout: float = 600.0
    item_pause: float = 25.0
    min_bytes: int = 2000

    @classmethod
    def from_env(cls) -> Config:
        """Defaults, overridden by LEXIVEC_CHUNK_TOKENS and the like; a value of the wrong type is an error."""
        found = {}
        for f in fields(cls):
            value = os.environ.get(f"LEXIVEC_{f.name.upper()}")
            if value is not None:
                found[f.name] = type(f.default)(value)
        return cls(**found)

    @property
    def overlap_tokens(self) -> int:
        return int(self.chunk_tokens * self.chunk_overlap)

    @property
    def pool_size(self) -> int:
        """Candidates that go to the reranker."""
        return max(self.dense_top_n, self.sparse_top_n)


DEFAULT = Config()
