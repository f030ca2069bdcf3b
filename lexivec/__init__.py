"""Hybrid retrieval, grounding and evaluation over text corpora, as Spark DataFrame jobs."""

from lexivec.config import Config

__all__ = ["Config"]
