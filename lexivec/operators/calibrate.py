"""Agreement of automatic scores with labels by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.operators.evaluate import value_counts


def average_ranks(rows: DataFrame, value: str, into: str) -> DataFrame:
    """rows with the rank of value, ties sharing the mean of theirs. Ranks are counted from the distinct values."""
    ranks = value_counts(rows, value, [])
    return rows.join(ranks.select(value, (F.col("before") + (F.col("n") + 1) / 2).alias(into)), value)


def pearson(x: Column | str, y: Column | str) -> Column:
    """The correlation, null where either side is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    n = F.count("*").cast("double")
    top = n * F.sum(x * y) - F.sum(x) * F.sum(y)
    spread = (n * F.sum(x * x) - F.sum(x) * F.sum(x)) * (n * F.sum(y * y) - F.sum(y) * F.sum(y))
    constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return F.when(constant, F.lit(None)).otherwise(F.try_divide(top, F.sqrt(F.greatest(spread, F.lit(0.0)))))


def agreement(pairs: DataFrame, hand: str, judge: str, at: float = 0.5) -> DataFrame:
    """One row: n, Pearson, Spearman, mean absolute error, and agreement of both sides of a threshold."""
    ranked = average_ranks(average_ranks(pairs, hand, "_h"), judge, "_j")
    h, j = F.col(hand).cast("double"), F.col(judge).cast("double")
    return ranked.agg(
        F.count("*").alias("n"), pearson(h, j).alias("pearson"), pearson("_h", "_j").alias("spearman"), F.avg(F.abs(h - j)).alias("mae"),
        F.avg(((h >= at) == (j >= at)).cast("int")).alias("agreement"),
    )


def kappa(pairs: DataFrame, hand: str, judge: str, at: float = 0.5) -> DataFrame:
    """One row: n and Cohen's kappa of both sides of a threshold, null where chance agreement is certain."""
    a, b = F.col(hand) >= at, F.col(judge) >= at
    n = F.count("*").cast("double")
    seen = F.count_if(a == b) / n
    chance = (F.count_if(a) * F.count_if(b) + F.count_if(~a) * F.count_if(~b)) / (n * n)
    return pairs.agg(F.count("*").alias("n"), seen.alias("po"), chance.alias("pe")).select("n", F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")).alias("kappa"))


def unlabelled(items: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return items.join(labels, key, "left_anti")
