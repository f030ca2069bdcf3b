"""Spans of texts: where a pattern matches, and how found spans meet labelled ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a bin: spans meet in the bins that they share, so that a text with many spans makes no pairs of all.
BIN = 256


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end>> of the matches of a pattern, in order, ends exclusive: the parts between matches give their places."""
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m))
    sizes = F.zip_with(between, found, lambda b, m: F.struct(b.alias("b"), F.coalesce(m, F.lit(0)).alias("m")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    state = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + x["b"]
        return F.struct((begin + x["m"]).alias("at"), F.when(x["m"] > 0, F.concat(s["out"], F.array(F.struct(begin.alias("start"), (begin + x["m"]).alias("end"))))).otherwise(s["out"]).alias("out"))

    return F.coalesce(F.aggregate(sizes, state, step)["out"], none)


def overlaps(found: DataFrame, labelled: DataFrame, by: str) -> DataFrame:
    """(by, start, end, label_start, label_end, shared) of each pair of a found and a labelled span (by, start, end) that share
    characters; null and empty spans share none.

    Spans are dealt to the bins that they cover and joined by bin; a pair that shares several counts in the first."""

    def binned(spans: DataFrame) -> DataFrame:
        return spans.where(F.col("start") < F.col("end")).select(by, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))).alias("bin"))

    labels = binned(labelled).select(by, "bin", F.col("start").alias("label_start"), F.col("end").alias("label_end"))
    both = binned(found).join(labels, [by, "bin"])
    begin = F.greatest("start", "label_start")
    shared = F.least("end", "label_end") - begin
    return both.where((shared > 0) & (F.floor(begin / BIN) == F.col("bin"))).select(by, "start", "end", "label_start", "label_end", shared.alias("shared"))


def span_scores(found: DataFrame, labelled: DataFrame, by: str, least: float = 0.5) -> DataFrame:
    """One row: n_found, n_labelled, hits (found spans whose best label has `least` of their union in common), met (labelled spans
    whose best found one has), precision and recall; null without a denominator.

    Spans are counted once if they repeat. Each found span is matched with its best label and the other way round."""
    found, labelled = found.select(by, "start", "end").distinct(), labelled.select(by, "start", "end").distinct()
    pairs = overlaps(found, labelled, by)
    union = (F.col("end") - F.col("start")) + (F.col("label_end") - F.col("label_start")) - F.col("shared")
    good = pairs.withColumn("part", F.col("shared") / union)

    def best(start: str, end: str, name: str) -> DataFrame:
        return good.groupBy(by, start, end).agg(F.max("part").alias("part")).agg(F.count_if(F.col("part") >= least).alias(name))

    out = found.agg(F.count("*").alias("n_found")).crossJoin(labelled.agg(F.count("*").alias("n_labelled")))  # of one row each
    out = out.crossJoin(best("start", "end", "hits")).crossJoin(best("label_start", "label_end", "met"))
    return out.withColumns({"precision": F.try_divide("hits", "n_found"), "recall": F.try_divide("met", "n_labelled")})
