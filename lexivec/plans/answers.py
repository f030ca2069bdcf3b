"""Queries that run from a question to its answer, its log row and its metrics, and through calls that fail."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.config import DEFAULT, Config
from lexivec.functions import scores as S
from lexivec.functions import text as T
from lexivec.operators import evaluate, ground, providers
from lexivec.plans import retrieval as R
from lexivec.plans.registry import query, table
from lexivec.sources.folders import materialize
from lexivec.streaming import events as E

def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark question answered from its five best chunks, by the provider that needs no model."""
    name = F.format_string("rfc%d#0000", "key")
    best = R.reranked(spark, sf).select("qid", name.alias("chunk_id"), "text", "pos")
    return ground.answered(best, R.questions(spark, sf), providers.chat_model("extractive", ""))


_ANSWERED = f"""{R.HYBRID_SQL},
held AS (SELECT item_id, 'rfc' || doc_id || '#0000' AS chunk_id, text, pos FROM top5 JOIN documents USING (doc_id)),
best AS (SELECT item_id, list(chunk_id ORDER BY pos) AS chunk_ids, arg_min(chunk_id, pos) AS first_id, regexp_extract(arg_min(text, pos), '(?s)^\\s*(.+?[.!?])(?:\\s|$)', 1) AS sentence FROM held GROUP BY 1),
answered AS (SELECT item_id, chunk_ids, CASE WHEN coalesce(sentence, '') = '' THEN '{T.ABSTAIN_SENTENCE.replace("'", "''")}' ELSE sentence || ' [' || first_id || ']' END AS said, coalesce(sentence, '') = '' AS none
  FROM benchmark LEFT JOIN best USING (item_id))"""


@query(f"""{_ANSWERED}
SELECT item_id, 'u' || (item_id % 5) AS client, array_to_string(coalesce(chunk_ids, []), ',') AS chunk_ids, CASE WHEN none THEN 0 ELSE 1 END::BIGINT AS n_citations,
  CASE WHEN none THEN '' ELSE chunk_ids[1] END AS cited, CASE WHEN none THEN 'abstained' ELSE 'answered' END AS outcome, sha256(said) AS text_sha256 FROM answered""")
def q_answers(spark: SparkSession, sf: str) -> DataFrame:
    """From question to citations and log entry. Times are not taken, so that runs are alike."""
    none = F.struct(*[F.lit(None).cast("double").alias(c) for c in ("retrieve", "rerank", "generate")])
    said = materialize(answers(spark, sf).select("qid", "chunks", "text", "citations"))
    rows = said.select(F.concat(F.lit("u"), (F.col("qid") % 5).cast("string")).alias("user"), F.col("qid").alias("request_id"), F.col("chunks").alias("retrieved"), none.alias("latency_ms"), "citations", "text")
    logged = E.log_entries(rows).select(F.col("request_id").alias("qid"), "user", "chunk_ids", "n_citations", "outcome")
    cited = F.coalesce(F.get(F.col("citations.chunk_id"), F.lit(0)), F.lit(""))
    return logged.join(said.select("qid", cited.alias("cited"), F.sha2("text", 256).alias("text_sha256")), "qid").select(
        F.col("qid").alias("item_id"), F.col("user").alias("client"), F.array_join("chunk_ids", ",").alias("chunk_ids"), F.col("n_citations").cast("bigint").alias("n_citations"), "cited", "outcome", "text_sha256"
    )


def _support_sql(name: str, text: str, context: str) -> str:
    """The part of the sentences of a text of which the context has half of the distinct tokens."""
    return f"""
{name}_c AS (SELECT item_id, unnest(list_filter(string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda c: regexp_matches(c, '[\\p{{L}}0-9]'))) AS claim, {context} AS context FROM judged),
{name} AS (SELECT item_id, avg(coalesce(len(list_intersect(list_distinct({R.TOK.format('claim')}), {R.TOK.format("coalesce(context, '')")})) >= 0.5 * len(list_distinct({R.TOK.format('claim')})) AND len({R.TOK.format('claim')}) > 0, false)::INT) AS score FROM {name}_c GROUP BY 1)"""


@query(f"""{_ANSWERED},
judged AS (SELECT a.item_id, b.text AS reference, trim(regexp_replace(said, '\\s*\\[rfc\\d+#\\d+\\]', '', 'g')) AS plain, string_agg(h.text, chr(10) ORDER BY pos) FILTER (pos > 1) AS others, string_agg(h.text, chr(10) ORDER BY pos) AS whole
  FROM answered a JOIN benchmark b USING (item_id) LEFT JOIN held h USING (item_id) GROUP BY a.item_id, b.text, said),
{_support_sql('f', 'plain', 'others')}, {_support_sql('r', 'reference', 'whole')},
v AS (SELECT t.item_id, avg(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS score FROM top5 t JOIN embeddings q ON q.vec_id = t.item_id JOIN embeddings e ON e.vec_id = t.doc_id GROUP BY 1)
SELECT item_id, round(coalesce(f.score, 0.0), 6) AS faithfulness, round(coalesce(r.score, 0.0), 6) AS context_recall, round(coalesce(v.score, 0.0), 6) AS answer_relevance
FROM benchmark LEFT JOIN f USING (item_id) LEFT JOIN r USING (item_id) LEFT JOIN v USING (item_id)""")
def q_judged_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The three metrics of the answers, by the judges that need no model: an answer is held against the chunks that it was not
    taken from, the benchmark text is the reference, and the chunks' vectors stand for questions that an answer suggests."""
    said = materialize(answers(spark, sf).select("qid", "question", "chunks", "text"))
    shown = F.transform("chunks", lambda c: c["text"])
    items = materialize(said.select("qid", "question", T.without_citations(F.col("text")).alias("plain"), F.array_join(F.slice(shown, 2, DEFAULT.rerank_top_k), "\n").alias("others"), F.array_join(shown, "\n").alias("whole")))
    faith = evaluate.faithfulness(items, ["qid"], "plain", "others")
    recall = evaluate.context_recall(items, ["qid"], "question", "whole")
    keys = said.select("qid", F.explode("chunks.chunk_id").alias("c")).select("qid", F.regexp_extract("c", r"rfc(\d+)#", 1).cast("bigint").alias("key"))
    asked = keys.join(R.vectors(spark, sf), "key").groupBy("qid").agg(F.collect_list(F.col("vector").cast("array<double>")).alias("asked"))
    vectors = said.select("qid").join(R.question_vectors(spark, sf).select("qid", F.col("vector").cast("array<double>").alias("vector")), "qid", "left").join(asked, "qid", "left")
    relevance = evaluate.answer_relevance(vectors, ["qid"], "vector", "asked")
    out = said.select("qid")
    for name, found in (("faithfulness", faith), ("context_recall", recall), ("answer_relevance", relevance)):
        out = out.join(found.select("qid", S.rounded(S.number(F.col("score"))).alias(name)), "qid", "left")
    return out.withColumnRenamed("qid", "item_id")


class Flaky:
    """A call that fails as often as the event says before it succeeds, in a way that a retry helps or not."""

    def __init__(self):
        self.calls: Counter[int] = Counter()

    def __call__(self, row: dict) -> dict:
        self.calls[row["event_id"]] += 1
        if row["user_id"] % 11 == 0:
            raise ValueError("no such item")
        if self.calls[row["event_id"]] <= row["event_id"] % 5:
            raise TimeoutError("503 unavailable, try again in 0s")
        return {"score": row["value"]}


@query("""SELECT event_id, CASE WHEN user_id % 11 = 0 THEN 1 ELSE least(event_id % 5 + 1, 4) END::BIGINT AS attempts, CASE WHEN user_id % 11 = 0 THEN 'ValueError: no such item' WHEN event_id % 5 > 3 THEN 'TimeoutError: 503 unavailable, try again in 0s' END AS error,
  CASE WHEN user_id % 11 <> 0 AND event_id % 5 <= 3 THEN value::DOUBLE END AS score FROM events""")
def q_retried_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Events through calls of which some fail for a while, some longer than three retries and some for good."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "value")
    called = evaluate.called_with_retries(rows, Flaky(), "score double", Config(max_retries=3, item_pause=0.0), sleep=_no_wait)
    return called.select("event_id", F.col("attempts").cast("bigint").alias("attempts"), "error", "score")


def _no_wait(seconds: float) -> None:
    pass
