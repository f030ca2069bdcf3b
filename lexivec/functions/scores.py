"""Functions on scores and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def faithfulness(raw: Column, abstained: Column) -> Column:
    """An abstention claims nothing and is faithful; without a number an answer is not."""
    return F.when(abstained, 1.0).otherwise(number(raw))


def number(raw: Column) -> Column:
    return F.coalesce(F.nanvl(raw, F.lit(0.0)), F.lit(0.0))


def attribution(faith: Column, relevance: Column, recall: Column, low: float, recall_floor: float) -> Column:
    """retrieval_fail if recall is under its floor, else generation_fail if the answer is weak, else pass; recall above its
    floor fails nothing."""
    return F.when(recall < recall_floor, "retrieval_fail").when((faith < low) | (relevance < low), "generation_fail").otherwise("pass")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    return F.transform(v.cast("array<double>"), lambda x: x / F.coalesce(F.nullif(F.sqrt(dot(v, v)), F.lit(0.0)), F.lit(1.0)))


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)
