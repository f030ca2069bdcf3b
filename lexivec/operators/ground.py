"""Grounding: what an answer cites, what goes into a prompt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.functions import text as T

def cited(answers: DataFrame) -> DataFrame:
    """answers (text, retrieved ids) with citations: valid ids and their documents, none where the answer abstains."""
    ids = F.when(T.abstains(F.col("text")), F.array().cast("array<string>")).otherwise(T.citations(F.col("text"), F.col("retrieved")))
    return answers.withColumn("citations", F.transform(ids, lambda c: F.struct(c.alias("chunk_id"), T.doc_of(c).alias("doc_id"), F.lit(None).cast("struct<start:int,end:int>").alias("span"))))


def unresolved(answers: DataFrame, key: str) -> DataFrame:
    """(key, chunk_id): cited ids that were not retrieved."""
    every = F.array_distinct(F.regexp_extract_all("text", F.lit(T.CITATION), F.lit(1)))
    return answers.select(key, F.explode(F.array_except(every, "retrieved")).alias("chunk_id"))


def contexts(ranked: DataFrame, by: str, rank: str, n: int | None = None) -> DataFrame:
    """(by, chunks): array<struct<chunk_id, text>> in rank order, the first n; groups are as long as the top-n before."""
    rows = ranked if n is None else ranked.where(F.col(rank) <= n)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), "chunk_id", "text")))
    return rows.groupBy(by).agg(F.transform(ordered, lambda x: F.struct(x["chunk_id"], x["text"])).alias("chunks"))


def answered(ranked: DataFrame, questions: DataFrame, provider: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(qid, question, chunks, prompt, text, citations) of questions (qid, question) with their best chunks (qid, chunk_id,
    text, pos): a provider answers from the prompt or the chunks; only citations of what was retrieved are kept. A
    question without chunks is asked all the same."""
    asked = questions.join(contexts(ranked, "qid", "pos"), "qid", "left")
    none = F.array().cast("array<struct<chunk_id:string,text:string>>")
    asked = asked.withColumn("chunks", F.coalesce("chunks", none)).withColumn("prompt", T.prompt(F.col("question"), F.col("chunks")))
    said = provider(asked).withColumn("retrieved", F.transform("chunks", lambda c: c["chunk_id"]))
    return cited(said).drop("retrieved")
