"""Guardrails: masked contact data, instruction phrases, and how well such rules do on labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+[0-9][0-9 ().-]{7,}[0-9]"
INJECTION = r"(?i)ignore (?:all |any )?(?:previous|prior|above) instructions|disregard the (?:system|above)|reveal (?:the|your) (?:system )?prompt|you are now"


def masked(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "<EMAIL>"), PHONE, "<PHONE>")


def contact_counts(text: Column) -> tuple[Column, Column]:
    return F.regexp_count(text, F.lit(EMAIL)).cast("bigint"), F.regexp_count(text, F.lit(PHONE)).cast("bigint")


def injected(text: Column) -> Column:
    """Whether a text tries to instruct the model that reads it."""
    return text.rlike(INJECTION)


def flag_rate(rows: DataFrame, flag: Column, by: str, most: float) -> DataFrame:
    """(by, n, flagged, rate, passes): passes where at most that part is flagged."""
    rate = F.avg(flag.cast("int"))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(flag).alias("flagged"), F.round(rate, 6).alias("rate"), (rate <= most).alias("passes"))


def precision_recall(rows: DataFrame, found: Column, truth: Column) -> DataFrame:
    """One row: true and false positives, false negatives, precision and recall; null without a denominator."""
    counts = rows.agg(F.count_if(found & truth).alias("tp"), F.count_if(found & ~truth).alias("fp"), F.count_if(~found & truth).alias("fn"))
    return counts.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
