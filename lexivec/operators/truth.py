"""Ground truth: drafts, assistance for reviewers, and the assembled set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.functions import text as T


def undrafted(seeds: DataFrame, drafts: DataFrame, key: str, order: str, n: int | None = None) -> DataFrame:
    """Seeds without a draft, the first n by order."""
    left = seeds.join(drafts, key, "left_anti")
    return left.orderBy(order).limit(n) if n else left


def drafted(answers: DataFrame) -> DataFrame:
    """answers (text, chunks: array<struct<chunk_id, text>>) with status, cited_chunk_ids and relevant_contexts: the cited
    texts of an answer with citations, else the first three."""
    ids = F.transform("chunks", lambda c: c["chunk_id"])
    abstains = T.abstains(F.col("text"))
    cited = F.when(abstains, F.array().cast("array<string>")).otherwise(T.citations(F.col("text"), ids))
    by_id = F.map_from_entries(F.transform("chunks", lambda c: F.struct(c["chunk_id"], c["text"])))
    status = F.when(abstains, "abstained").when(F.size("cited_chunk_ids") > 0, "ok").otherwise("no_citation")
    first = F.transform(F.slice("chunks", 1, 3), lambda c: c["text"])
    chosen = F.when(F.col("status") == "ok", F.transform("cited_chunk_ids", lambda c: F.element_at(by_id, c))).otherwise(first)
    return answers.withColumn("cited_chunk_ids", cited).withColumn("status", status).withColumn("relevant_contexts", chosen)


def assembled(seeds: DataFrame, authored: DataFrame, drafts: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, problems) of seeds (pos, question), authored (pos, answer, ctx), drafts (question, answer, ctx, status) and
    chunks (chunk_id, text). An authored answer comes before a draft, of which only those with status ok count; every
    context must be a chunk, and there must be one."""
    ok = drafts.where("status = 'ok'").select("question", F.col("answer").alias("d_answer"), F.col("ctx").alias("d_ctx"))
    both = seeds.join(authored.withColumnsRenamed({"answer": "a_answer", "ctx": "a_ctx"}), "pos", "left").join(ok, "question", "left")
    chosen = both.select("pos", "question", F.coalesce("a_answer", "d_answer").alias("answer"), F.when(F.col("a_answer").isNotNull(), F.col("a_ctx")).otherwise(F.col("d_ctx")).alias("ctx"))
    parts = chosen.where("answer is not null").select("pos", F.posexplode("ctx").alias("i", "chunk_id")).join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    found = parts.groupBy("pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("relevant_contexts"),
        F.array_sort(F.collect_list(F.when(F.col("text").isNull(), F.col("chunk_id")))).alias("missing"),
    )
    judged = chosen.join(found, "pos", "left").withColumn(
        "problem",
        F.when(F.col("answer").isNull(), "no authored entry and no ok draft").when(F.size("missing") > 0, F.concat(F.lit("missing chunk_ids "), F.array_join("missing", ","))).when(F.col("missing").isNull(), "no relevant_contexts"),
    )
    items = judged.where("problem is null").select("pos", "question", T.without_citations(F.col("answer")).alias("reference_answer"), "relevant_contexts")
    return items, judged.where("problem is not null").select("pos", "question", "problem")


def assisted(seeds: DataFrame, drafts: DataFrame, candidates: DataFrame, n: int) -> DataFrame:
    """seeds (qid, ...) with the last draft of each (qid, seq, draft), if any, and its first n candidates in rank order."""
    last = drafts.groupBy("qid").agg(F.max_by("draft", "seq").alias("existing_draft"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), "chunk_id")))
    lists = candidates.where(F.col("rank") <= n).groupBy("qid").agg(F.transform(ordered, lambda x: x["chunk_id"]).alias("candidates"))
    return seeds.join(last, "qid", "left").join(lists, "qid", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
