"""All named queries and their SQL."""

from __future__ import annotations

from lexivec.plans import answers, evaluation, retrieval, streams
from lexivec.plans.registry import ORACLES, QUERIES
from lexivec.plans.retrieval import flagship

__all__ = ["ORACLES", "QUERIES", "answers", "evaluation", "flagship", "retrieval", "streams"]
