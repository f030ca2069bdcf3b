"""Queries on grounding, ground truth, scored runs, calibration and operations. Scored items are made from labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.config import DEFAULT
from lexivec.functions import scores as S
from lexivec.functions import text as T
from lexivec.operators import calibrate, evaluate, ground, guard, latency, retrieve, spans, truth
from lexivec.plans import retrieval as R
from lexivec.plans.registry import query, table
from lexivec.sources import corpus

r6 = S.rounded


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Raw scores by doc_id, with NaN for some and abstentions for others, in three runs."""
    i = F.col("doc_id")
    raw = F.when(i % 17 == 0, float("nan")).otherwise((i * 37 % 101) / 100.0)
    return table(spark, sf, "labels").select(
        "doc_id", F.concat(F.lit("sha"), (i % 3).cast("string")).alias("git_sha"), raw.alias("faith"), ((i * 53 % 101) / 100.0).alias("arel"), ((i * 71 % 101) / 100.0).alias("crec"),
        (i % 23 == 0).alias("abstained"),
    )


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.attributed(evaluate.coerced(scored(spark, sf)))


S_SQL = """
s AS (SELECT doc_id, 'sha' || (doc_id % 3) AS git_sha, CASE WHEN doc_id % 17 = 0 THEN 'nan'::DOUBLE ELSE (doc_id * 37 % 101)::DOUBLE / 100.0 END AS faith,
  (doc_id * 53 % 101)::DOUBLE / 100.0 AS arel, (doc_id * 71 % 101)::DOUBLE / 100.0 AS crec, doc_id % 23 = 0 AS abstained FROM labels),
c AS (SELECT doc_id, git_sha, CASE WHEN abstained THEN 1.0 WHEN isnan(faith) THEN 0.0 ELSE faith END AS faith, arel, crec FROM s),
a AS (SELECT *, CASE WHEN crec < 0.5 THEN 'retrieval_fail' WHEN faith < 0.6 OR arel < 0.6 THEN 'generation_fail' ELSE 'pass' END AS attribution FROM c),
m AS (SELECT git_sha, count(*) AS n, avg(faith) AS faithfulness, avg(arel) AS answer_relevance, avg(crec) AS context_recall FROM a GROUP BY 1)"""


# Grounding


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """An answer for each document: two valid citations, one of them twice, and one of a chunk that was not retrieved."""
    d = F.col("doc_id").cast("string")
    text = F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in ("See [rfc", d, "#0002], then [rfc", d, "#0001] and [rfc", d, "#0002] again, not [rfc", d, "#0007].")])
    return table(spark, sf, "documents").select("doc_id", text.alias("text"), F.array(*[F.concat(F.lit("rfc"), d, F.lit(f"#000{k}")) for k in (1, 2, 3)]).alias("retrieved"))


_ANSWERS = """ans AS (SELECT doc_id, 'See [rfc' || doc_id || '#0002], then [rfc' || doc_id || '#0001] and [rfc' || doc_id || '#0002] again, not [rfc' || doc_id || '#0007].' AS text,
  ['rfc' || doc_id || '#0001', 'rfc' || doc_id || '#0002', 'rfc' || doc_id || '#0003'] AS retrieved FROM documents),
ids AS (SELECT *, regexp_extract_all(text, '\\[(rfc\\d+#\\d+)\\]', 1) AS l FROM ans)"""


@query(f"WITH {_ANSWERS} SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i AND list_contains(retrieved, x)), ',') AS cited, 'rfc' || doc_id AS first_doc FROM ids")
def q_citations(spark: SparkSession, sf: str) -> DataFrame:
    c = ground.cited(answers(spark, sf))
    return c.select("doc_id", F.array_join(F.transform("citations", lambda x: x["chunk_id"]), ",").alias("cited"), F.col("citations")[0]["doc_id"].alias("first_doc"))


@query(f"WITH {_ANSWERS} SELECT doc_id, unnest(list_filter(list_distinct(l), lambda x: NOT list_contains(retrieved, x))) AS chunk_id FROM ids")
def q_unresolved_citations(spark: SparkSession, sf: str) -> DataFrame:
    return ground.unresolved(answers(spark, sf), "doc_id")


@query(f"WITH {_ANSWERS} SELECT doc_id, trim(regexp_replace(text, '\\s*\\[rfc\\d+#\\d+\\]', '', 'g')) AS plain FROM ans")
def q_strip_citations(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("doc_id", T.without_citations(F.col("text")).alias("plain"))


@query("""WITH t AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT item_id, -1, '  I DON''T have enough information in the PROVIDED context to answer that. ' FROM benchmark)
SELECT conv_id, turn, starts_with(lower(trim(text)), 'i don''t have enough information in the provided context') AS abstained FROM t""")
def q_abstention(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "benchmark").select(F.col("item_id").alias("conv_id"), F.lit(-1).cast("bigint").alias("turn"), F.lit("  I DON'T have enough information in the PROVIDED context to answer that. ").alias("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", "text").unionByName(said).select("conv_id", "turn", T.abstains(F.col("text")).alias("abstained"))


@query(f"""WITH {R.BM25_SQL}
SELECT item_id, sha256('Context passages:' || chr(10) || chr(10) || string_agg('[' || doc_id || '#0000]' || chr(10) || d.text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || any_value(b.text)) AS prompt_sha256
FROM sparse JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE rank <= 5 GROUP BY item_id""")
def q_prompt(spark: SparkSession, sf: str) -> DataFrame:
    asked = R.questions(spark, sf)
    best = retrieve.bm25_top(asked, R.sparse_index(spark, sf), DEFAULT.rerank_top_k).join(R.chunks(spark, sf), "key")
    lists = ground.contexts(best.withColumn("chunk_id", T.chunk_id(F.col("key"), F.lit(0))), "qid", "rank")
    return lists.join(asked, "qid").select(F.col("qid").alias("item_id"), F.sha2(T.prompt(F.col("question"), F.col("chunks")), 256).alias("prompt_sha256"))


@query("""SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 0 THEN role WHEN 1 THEN 'role: ' || role || ' #' || turn ELSE '' END AS part FROM conversations""")
def q_part_text(spark: SparkSession, sf: str) -> DataFrame:
    shape, turn = (F.col("conv_id") + F.col("turn")) % 3, F.col("turn").cast("string")
    parts = F.concat(F.lit('["role: ", {"type": "text", "text": "'), F.col("role"), F.lit('"}, {"type": "image"}, " #'), turn, F.lit('"]'))
    content = F.when(shape == 0, F.concat(F.lit('"'), F.col("role"), F.lit('"'))).when(shape == 1, parts).otherwise('{"n": 1}')
    return table(spark, sf, "conversations").select("conv_id", "turn", T.part_text(content).alias("part"))


@query("""SELECT CASE WHEN length(text) BETWEEN 1 AND 2000 THEN 'ok' ELSE 'rejected' END AS verdict, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1""")
def q_validate_requests(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.length("text").between(1, 2000)
    return table(spark, sf, "conversations").where("role = 'user'").groupBy(F.when(ok, "ok").otherwise("rejected").alias("verdict")).agg(F.count("*").alias("n"))


# Ground truth


def draft_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents' answers in turn: with citations, abstaining, or without; each over four chunks."""
    i, d = F.col("doc_id"), F.col("doc_id").cast("string")
    chunks = F.array(*[F.struct(F.concat(F.lit("rfc"), d, F.lit(f"#000{k}")).alias("chunk_id"), F.concat(F.lit(f"body {k} of "), d).alias("text")) for k in (1, 2, 3, 4)])
    text = F.when(i % 3 == 0, F.concat(F.lit("A [rfc"), d, F.lit("#0004] B [rfc"), d, F.lit("#0002]"))).when(i % 3 == 1, T.ABSTAIN_SENTENCE).otherwise("no marker")
    return table(spark, sf, "documents").select("doc_id", "source", text.alias("text"), chunks.alias("chunks"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'abstained' ELSE 'no_citation' END AS status,
CASE WHEN doc_id % 3 = 0 THEN 'body 4 of ' || doc_id || '|body 2 of ' || doc_id ELSE 'body 1 of ' || doc_id || '|body 2 of ' || doc_id || '|body 3 of ' || doc_id END AS contexts FROM documents""")
def q_draft_item(spark: SparkSession, sf: str) -> DataFrame:
    return truth.drafted(draft_answers(spark, sf)).select("doc_id", "status", F.array_join("relevant_contexts", "|").alias("contexts"))


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("pos"), F.col("item_id").alias("qid"), F.col("text").alias("question"))


@query("SELECT item_id AS pos, text AS question FROM benchmark WHERE item_id NOT IN (SELECT conv_id FROM conversations WHERE turn >= 3) ORDER BY pos LIMIT 10")
def q_todo_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    drafts = table(spark, sf, "conversations").where("turn >= 3").select(F.col("conv_id").alias("pos")).distinct()
    return truth.undrafted(seeds(spark, sf), drafts, "pos", "pos", 10).select("pos", "question")


@query("SELECT item_id AS pos, text AS question FROM benchmark WHERE item_id NOT IN (SELECT conv_id FROM conversations WHERE turn >= 3)")
def q_todo_all(spark: SparkSession, sf: str) -> DataFrame:
    """All seeds without a draft; q_todo_antijoin has the first ten."""
    drafts = table(spark, sf, "conversations").where("turn >= 3").select(F.col("conv_id").alias("pos")).distinct()
    return truth.undrafted(seeds(spark, sf), drafts, "pos", "pos").select("pos", "question")


@query(f"""WITH {R.BM25_SQL}, last AS (SELECT conv_id, arg_max(text, turn) AS draft FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT item_id, draft AS existing_draft, string_agg(doc_id || '#0000', ',' ORDER BY rank) AS candidates FROM benchmark LEFT JOIN last ON conv_id = item_id JOIN sparse USING (item_id) WHERE rank <= 6 GROUP BY ALL""")
def q_assist(spark: SparkSession, sf: str) -> DataFrame:
    drafts = table(spark, sf, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("qid"), F.col("turn").alias("seq"), F.col("text").alias("draft"))
    best = retrieve.bm25_top(R.questions(spark, sf), R.sparse_index(spark, sf)).withColumn("chunk_id", T.chunk_id(F.col("key"), F.lit(0)))
    out = truth.assisted(seeds(spark, sf), drafts, best, 6)
    return out.select(F.col("qid").alias("item_id"), "existing_draft", F.array_join("candidates", ",").alias("candidates"))


def assembled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every document is a seed. Some have an authored entry, some drafts are not ok, some contexts are not chunks."""
    i, d = F.col("doc_id"), F.col("doc_id").cast("string")
    docs = table(spark, sf, "documents")
    chunk = F.concat(d, F.lit("#0000"))
    seed = docs.select(i.alias("pos"), F.concat(F.lit("q"), d).alias("question"))
    authored = docs.where(i % 5 == 0).select(i.alias("pos"), F.concat(F.lit("by hand [rfc1#0001] "), d).alias("answer"), F.when(i % 15 == 0, F.array(chunk, F.concat(d, F.lit("#9999")))).otherwise(F.array(chunk)).alias("ctx"))
    ctx = F.when(i % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(chunk, F.concat((i - i % 2).cast("string"), F.lit("#0000"))))
    drafts = docs.select(F.concat(F.lit("q"), d).alias("question"), F.concat(F.lit("draft "), d, F.lit(" [rfc1#0001]")).alias("answer"), ctx.alias("ctx"), F.when(i % 4 == 0, "abstained").otherwise("ok").alias("status"))
    chunks = docs.select(chunk.alias("chunk_id"), F.concat(F.lit("text of "), d).alias("text"))
    return truth.assembled(seed, authored, drafts, chunks)


_ASSEMBLED = """
e AS (SELECT doc_id AS pos, CASE WHEN doc_id % 5 = 0 THEN 'by hand ' || doc_id WHEN doc_id % 4 <> 0 THEN 'draft ' || doc_id END AS answer,
  CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 15 = 0 THEN [doc_id, NULL] ELSE [doc_id] END WHEN doc_id % 4 <> 0 THEN CASE WHEN doc_id % 7 = 0 THEN [] ELSE [doc_id, doc_id - doc_id % 2] END END AS ctx FROM documents),
j AS (SELECT *, CASE WHEN answer IS NULL THEN 'no authored entry and no ok draft' WHEN len(list_filter(ctx, lambda x: x IS NULL)) > 0 THEN 'missing chunk_ids ' || pos || '#9999' WHEN len(ctx) = 0 THEN 'no relevant_contexts' END AS problem FROM e)"""


@query(f"WITH {_ASSEMBLED} SELECT pos, 'q' || pos AS question, answer AS reference_answer, array_to_string(list_transform(ctx, lambda x: 'text of ' || x), '|') AS contexts FROM j WHERE problem IS NULL")
def q_assemble_gt(spark: SparkSession, sf: str) -> DataFrame:
    return assembled(spark, sf)[0].select("pos", "question", "reference_answer", F.array_join("relevant_contexts", "|").alias("contexts"))


@query(f"WITH {_ASSEMBLED} SELECT pos, 'q' || pos AS question, problem FROM j WHERE problem IS NOT NULL")
def q_missing_ctx(spark: SparkSession, sf: str) -> DataFrame:
    return assembled(spark, sf)[1]


@query(f"WITH {R.GOLD_SQL} SELECT item_id, count(doc_id) AS n_contexts FROM benchmark LEFT JOIN gold USING (item_id) GROUP BY 1")
def q_ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    found = R.gold(spark, sf).groupBy("qid").agg(F.count("*").alias("n"))
    return R.questions(spark, sf).join(found, "qid", "left").select(F.col("qid").alias("item_id"), F.coalesce("n", F.lit(0)).alias("n_contexts"))


# Runs


@query("""WITH n AS (SELECT count(*) AS l FROM documents), p AS (SELECT DISTINCT round_even(i * (l - 1) / 9.0, 0)::BIGINT AS position FROM n, range(10) t(i))
SELECT doc_id, position FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents) JOIN p USING (position)""")
def q_subset(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.subset(table(spark, sf, "documents").select("doc_id"), DEFAULT.ci_subset_size, "doc_id")


@query(f"WITH {S_SQL} SELECT doc_id, arel, crec FROM s WHERE git_sha = 'sha1'")
def q_checkpoint_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).where("git_sha = 'sha1'").select("doc_id", "arel", "crec")


@query(f"WITH {S_SQL} SELECT git_sha, doc_id, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE faith END::DOUBLE AS faith FROM c")
def q_upsert(spark: SparkSession, sf: str) -> DataFrame:
    first = evaluate.coerced(scored(spark, sf)).select("git_sha", "doc_id", "faith", F.lit(1).alias("seq"))
    again = first.where("doc_id % 2 = 0").withColumn("faith", F.lit(1.0)).withColumn("seq", F.lit(2))
    return evaluate.last_written(first.unionByName(again), ["git_sha", "doc_id"], "seq").drop("seq")


@query(f"WITH {S_SQL} SELECT d.doc_id, s.doc_id IS NOT NULL AS reused, s.arel FROM documents d LEFT JOIN s USING (doc_id)")
def q_resume(spark: SparkSession, sf: str) -> DataFrame:
    done, todo = evaluate.resume_split(table(spark, sf, "documents").select("doc_id"), scored(spark, sf).select("doc_id", "arel"), "doc_id")
    return done.withColumn("reused", F.lit(True)).unionByName(todo.withColumn("reused", F.lit(False)), allowMissingColumns=True)


@query(f"WITH {S_SQL} SELECT doc_id, faith::DOUBLE AS faith, arel, crec FROM c")
def q_coerce(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.coerced(scored(spark, sf)).select("doc_id", "faith", "arel", "crec")


@query(f"WITH {S_SQL} SELECT doc_id, attribution FROM a")
def q_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).select("doc_id", "attribution")


@query(f"WITH {S_SQL} SELECT git_sha, count(*) FILTER (attribution = 'retrieval_fail') AS retrieval_fail, count(*) FILTER (attribution = 'generation_fail') AS generation_fail FROM a GROUP BY 1")
def q_attr_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.attribution_counts(classified(spark, sf), "git_sha")


def rounded_means(df: DataFrame) -> DataFrame:
    for c in ("faithfulness", "answer_relevance", "context_recall"):
        df = df.withColumn(c, r6(F.col(c)))
    return df


@query(f"WITH {S_SQL} SELECT git_sha, n, round(faithfulness, 6) AS faithfulness, round(answer_relevance, 6) AS answer_relevance, round(context_recall, 6) AS context_recall FROM m")
def q_eval_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_means(evaluate.means(classified(spark, sf), "git_sha"))


@query(f"""WITH {S_SQL} SELECT git_sha, n, CASE WHEN faithfulness >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS printed, CASE WHEN n >= 6 AND faithfulness >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS gate,
CASE WHEN n < 6 THEN 'insufficient coverage — only ' || n || '/6 items scored' WHEN faithfulness >= 0.8 THEN printf('mean faithfulness %.3f >= 0.80', faithfulness) ELSE printf('mean faithfulness %.3f < 0.80', faithfulness) END AS reason FROM m""")
def q_ci_gate(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.gate(evaluate.means(classified(spark, sf), "git_sha")).select("git_sha", "n", "printed", "gate", "reason")


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of each assistant turn, with whether they share a token with the turn before."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    lines = turns.where("role = 'assistant'").join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", "context", F.explode(F.split("text", "\n")).alias("claim"))
    return lines.withColumn("supported", F.coalesce(F.arrays_overlap(T.tokens(F.col("claim")), T.tokens(F.col("context"))), F.lit(False)))


@query(f"""WITH l AS (SELECT a.conv_id, a.turn, unnest(string_split(a.text, chr(10))) AS claim, b.text AS context FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant')
SELECT conv_id, turn, round(avg(coalesce(list_has_any({R.TOK.format('claim')}, {R.TOK.format('context')}), false)::INT), 6) AS faithfulness FROM l GROUP BY 1, 2""")
def q_faithfulness(spark: SparkSession, sf: str) -> DataFrame:
    judged = evaluate.ratio_of_verdicts(_claims(spark, sf).withColumn("k", F.struct("conv_id", "turn")), "k", "supported")
    return judged.select("k.conv_id", "k.turn", r6(F.col("score")).alias("faithfulness"))


@query(f"WITH {R.BM25_SQL}, {R.GOLD_SQL} SELECT item_id, round(avg((rank IS NOT NULL)::INT), 6) AS context_recall FROM gold LEFT JOIN sparse USING (item_id, doc_id) GROUP BY 1")
def q_context_recall(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieve.recall_at(retrieve.bm25_top(R.questions(spark, sf), R.sparse_index(spark, sf)), R.gold(spark, sf), DEFAULT.sparse_top_n, "rank")
    return found.select(F.col("qid").alias("item_id"), r6(F.col("recall")).alias("context_recall"))


@query(f"WITH {R.DENSE_SQL} SELECT item_id, round(avg(score), 6) AS answer_relevance FROM dense WHERE rank <= 3 GROUP BY 1")
def q_answer_relevance(spark: SparkSession, sf: str) -> DataFrame:
    best = retrieve.dense_top(R.question_vectors(spark, sf), R.vectors(spark, sf), 3)
    return best.groupBy(F.col("qid").alias("item_id")).agg(r6(F.avg("score")).alias("answer_relevance"))


@query(f"""WITH {S_SQL}
SELECT git_sha, doc_id, {{'doc_id': doc_id, 'faith': faith::DOUBLE, 'arel': arel, 'crec': crec, 'attribution': attribution}}::JSON::VARCHAR AS json FROM a
UNION ALL SELECT git_sha, NULL, {{'git_sha': git_sha, 'means': {{'faithfulness': round(faithfulness::DOUBLE, 13), 'answer_relevance': round(answer_relevance, 13), 'context_recall': round(context_recall, 13)}}, 'attribution_counts': {{'retrieval_fail': (SELECT count(*) FROM a WHERE a.git_sha = m.git_sha AND attribution = 'retrieval_fail'), 'generation_fail': (SELECT count(*) FROM a WHERE a.git_sha = m.git_sha AND attribution = 'generation_fail')}}}}::JSON::VARCHAR FROM m""")
def q_export_json(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON row for each item, and one with null as doc_id for each run."""
    return evaluate.exported_rows(classified(spark, sf).select("git_sha", "doc_id", "faith", "arel", "crec", "attribution"), "git_sha", "doc_id")


@query(f"WITH {S_SQL} SELECT git_sha, round(faithfulness, 6) AS faithfulness, round(faithfulness - lag(faithfulness) OVER (ORDER BY git_sha), 6) AS delta, round(faithfulness - 0.8, 6) AS above FROM m")
def q_trends(spark: SparkSession, sf: str) -> DataFrame:
    t = evaluate.trends(evaluate.means(classified(spark, sf), "git_sha"), "git_sha")
    return t.select("git_sha", *[r6(F.col(c)).alias(c) for c in ("faithfulness", "delta", "above")])


@query(f"WITH {S_SQL} SELECT git_sha, doc_id, doc_id || '#000' || k AS chunk_id, CASE k WHEN 0 THEN faith ELSE arel END::DOUBLE AS rerank FROM c, range(2) t(k)")
def q_drilldown(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id").cast("string")
    kept = F.to_json(F.array(*[F.struct(F.concat(d, F.lit(f"#000{k}")).alias("chunk_id"), F.lit(None).cast("double").alias("dense"), F.col(c).alias("rerank")) for k, c in enumerate(("faith", "arel"))]), {"ignoreNullFields": "false"})
    items = evaluate.coerced(scored(spark, sf)).select("git_sha", "doc_id", kept.alias("retrieved_json"))
    read = F.from_json("retrieved_json", "array<struct<chunk_id: string, dense: double, rerank: double>>")
    return items.select("git_sha", "doc_id", F.explode(read).alias("c")).select("git_sha", "doc_id", "c.chunk_id", "c.rerank")


@query(f"WITH {S_SQL} SELECT git_sha, attribution, count(*) AS n, string_agg(doc_id, ',' ORDER BY doc_id) AS ids FROM a WHERE attribution <> 'pass' GROUP BY 1, 2")
def q_offenders(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.ids_by_bucket(classified(spark, sf), "git_sha", "doc_id").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query(f"""WITH {S_SQL} SELECT git_sha, attribution, doc_id, NULL::BIGINT AS n FROM a WHERE attribution <> 'pass'
UNION ALL SELECT git_sha, attribution, NULL, count(*) FROM a WHERE attribution <> 'pass' GROUP BY 1, 2""")
def q_offender_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What q_offenders has as one row for each bucket, for any number of failures."""
    return evaluate.offenders(classified(spark, sf), "git_sha", "doc_id")


# Calibration


@query(f"WITH {S_SQL} SELECT git_sha, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, git_sha LIMIT 1")
def q_top_run(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.best_counted(scored(spark, sf), "git_sha")


@query(f"WITH {S_SQL}, b AS (SELECT git_sha FROM s GROUP BY 1 ORDER BY count(*) DESC, git_sha LIMIT 1) SELECT left(sha1('q' || doc_id), 8) AS qkey, doc_id, faith::DOUBLE AS faith FROM c WHERE git_sha = (SELECT git_sha FROM b)")
def q_calib_items(spark: SparkSession, sf: str) -> DataFrame:
    best = evaluate.best_counted(scored(spark, sf), "git_sha")
    items = evaluate.coerced(scored(spark, sf)).join(best, "git_sha", "left_semi")
    return items.select(T.question_key(F.concat(F.lit("q"), F.col("doc_id").cast("string"))).alias("qkey"), "doc_id", "faith").orderBy("qkey")


@query("SELECT doc_id, left(sha1(text), 8) AS qkey FROM documents")
def q_qkey(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.question_key(F.col("text")).alias("qkey"))


def paired(spark: SparkSession, sf: str) -> DataFrame:
    hand = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("hand"))
    return hand.join(evaluate.coerced(scored(spark, sf)).select("doc_id", F.col("faith").alias("judge")), "doc_id")


@query(f"""WITH {S_SQL}, p AS (SELECT quality::DOUBLE AS h, faith AS j FROM labels JOIN c USING (doc_id)),
r AS (SELECT *, rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2.0 AS rh, rank() OVER (ORDER BY j) + (count(*) OVER (PARTITION BY j) - 1) / 2.0 AS rj FROM p)
SELECT count(*) AS n, round(corr(h, j), 6) AS pearson, round(corr(rh, rj), 6) AS spearman, round(avg(abs(h - j)), 6) AS mae, round(avg(((h >= 0.5) = (j >= 0.5))::INT), 6) AS agreement FROM r""")
def q_calibration(spark: SparkSession, sf: str) -> DataFrame:
    found = calibrate.agreement(paired(spark, sf), "hand", "judge")
    return found.select("n", *[r6(F.col(c)).alias(c) for c in ("pearson", "spearman", "mae", "agreement")])


@query(f"""WITH {S_SQL}, p AS (SELECT quality >= 0.5 AS h, faith >= 0.5 AS j FROM labels JOIN c USING (doc_id)),
k AS (SELECT count(*) AS n, avg((h = j)::INT) AS po, avg(h::INT) * avg(j::INT) + (1 - avg(h::INT)) * (1 - avg(j::INT)) AS pe FROM p) SELECT n, round((po - pe) / (1 - pe), 6) AS kappa FROM k""")
def q_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return calibrate.kappa(paired(spark, sf), "hand", "judge").withColumn("kappa", r6(F.col("kappa")))


# Operations


@query("""SELECT event_type, count(value) AS n, round(avg(value::DECIMAL(18,6)), 1) AS mean, round(quantile_cont(value, 0.5), 1) AS p50, round(quantile_cont(value, 0.95), 1) AS p95,
round(quantile_cont(value, 0.99), 1) AS p99, round(min(value), 1) AS min, round(max(value), 1) AS max FROM events GROUP BY 1""")
def q_latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    return latency.summary(table(spark, sf, "events"), "event_type", "value")


@query("""SELECT conv_id, CASE WHEN bool_or(starts_with(lower(trim(text)), 'i don''t have enough information in the provided context')) THEN 'abstained' ELSE 'answered' END AS outcome,
sum(len(regexp_extract_all(text, '\\[(rfc\\d+#\\d+)\\]', 1)))::BIGINT AS n_citations, round(sum(length(text)) / 4.0, 1)::DOUBLE AS generate_ms FROM conversations WHERE role = 'assistant' GROUP BY 1""")
def q_query_log(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "conversations").where("role = 'assistant'")
    n = F.size(F.regexp_extract_all("text", F.lit(T.CITATION), F.lit(1)))
    return said.groupBy("conv_id").agg(
        F.when(F.bool_or(T.abstains(F.col("text"))), "abstained").otherwise("answered").alias("outcome"), F.sum(n).alias("n_citations"), F.round(F.sum(F.length("text")) / 4.0, 1).alias("generate_ms")
    )


_FILES = "f AS (SELECT page_id, html, strlen(html) AS bytes, sha256(html) AS sha256, CASE WHEN strlen(html) >= 2000 THEN 'skipped-exists' ELSE 'failed' END AS status FROM pages)"


@query(f"WITH {_FILES} SELECT page_id, bytes, sha256, status FROM f")
def q_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.provenance(table(spark, sf, "pages"), "page_id", "html", DEFAULT.min_bytes)


@query(f"WITH {_FILES} SELECT count(*) AS n_files, sum(bytes)::BIGINT AS total_bytes, 0::BIGINT AS fetched, count(*) FILTER (status = 'skipped-exists') AS skipped, count(*) FILTER (status = 'failed') AS failed FROM f")
def q_provenance_totals(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.provenance_totals(corpus.provenance(table(spark, sf, "pages"), "page_id", "html", DEFAULT.min_bytes))


@query("""WITH m AS (SELECT doc_id AS number FROM documents)
SELECT number, CASE WHEN page_id IS NULL THEN 'MISSING' WHEN strlen(html) < 2000 THEN 'BAD: too small (' || strlen(html) || ' bytes) - likely an error page' ELSE 'BAD: header does not name RFC ' || number END AS problem
FROM m LEFT JOIN pages ON page_id = number WHERE page_id IS NULL OR strlen(html) < 2000 OR NOT (contains(left(html, 4000), 'RFC ' || number) OR contains(left(html, 4000), 'Request for Comments: ' || number))""")
def q_verify_docs(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "pages").select(F.col("page_id").alias("number"), "html")
    listed = table(spark, sf, "documents").select(F.col("doc_id").alias("number"))
    return corpus.integrity(listed, corpus.verified(files, "number", "html", DEFAULT.min_bytes), "number")


# Messages like those of model services; an event has one by its number, with numbers of its own.
MESSAGES = (
    "HTTP 429 Too Many Requests: please retry in {d}s.", "RateLimitError: Please Try Again In {d}s", "ResourceExhausted {{'retryDelay': '{n}s'}}", "OutputParserException: Failed to parse item {n}",
    "ValueError: bad argument {d}", "connection reset by peer {n}", "Quota exceeded, retry in {d}s; retryDelay: {n}s", "validation error for field {n}", "Deadline passed after {n} ms", "", "HTTP 404 Not Found: page {n}", "{n} of {d} retries in vain",
)


def _message(parts: tuple[str, ...] = MESSAGES) -> str:
    """SQL, of Spark and DuckDB alike, for the message of an event."""
    n, d = "CAST(event_id * 7 % 90 + 10 AS STRING)", "CAST(event_id % 97 AS STRING) || '.' || CAST(event_id % 10 AS STRING)"
    quoted = [m.replace("'", "''").replace("{{", "{").replace("}}", "}").replace("{d}", f"' || {d} || '").replace("{n}", f"' || {n} || '") for m in parts]
    return "CASE event_id % " + str(len(parts)) + " " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(quoted)) + " END"


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", (F.col("event_id") % 7 + 1).alias("attempt"), F.expr(_message()).alias("message"))


def _any(words: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(lower(message), '{w}')" for w in words)


_MESSAGES = f"""WITH m AS (SELECT event_id, event_id % 7 + 1 AS attempt, {_message()} AS message FROM events),
e AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(message, '(?i)(?:retry|try again) in ([0-9.]+)s', 1), '') AS DOUBLE), try_cast(nullif(regexp_extract(message, 'retryDelay''?:?\\s*''?([0-9]+)s', 1), '') AS DOUBLE)) AS delay FROM m)"""


@query(_MESSAGES + f" SELECT event_id, CASE WHEN {_any(T.TRANSIENT)} THEN 'transient' WHEN {_any(T.PARSE)} THEN 'parse' ELSE 'fatal' END AS class FROM e")
def q_error_class(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("event_id", T.error_class(F.col("message")).alias("class"))


@query(_MESSAGES + " SELECT event_id, delay FROM e")
def q_retry_delay(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("event_id", T.retry_delay(F.col("message")).alias("delay"))


@query(_MESSAGES + " SELECT event_id, least(coalesce(delay + 1, 2.0 * pow(2.0, attempt - 1)), 65.0)::DOUBLE AS wait FROM e")
def q_backoff(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("event_id", T.backoff(T.retry_delay(F.col("message")), F.col("attempt"), DEFAULT.backoff_base, DEFAULT.backoff_cap).alias("wait"))


@query("SELECT conv_id, turn, length(text) BETWEEN 1 AND 2000 AS valid FROM conversations WHERE role = 'user'")
def q_valid_questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", T.valid_question(F.col("text")).alias("valid"))


@query(f"WITH {R.GOLD_SQL}, n AS (SELECT item_id, count(doc_id) AS n FROM benchmark LEFT JOIN gold USING (item_id) GROUP BY 1) SELECT count(*) AS n_items, round(avg(n), 6) AS mean_contexts FROM n")
def q_mean_contexts(spark: SparkSession, sf: str) -> DataFrame:
    counts = R.gold(spark, sf).groupBy("qid").agg(F.count("*").alias("n"))
    items = R.questions(spark, sf).join(counts, "qid", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return evaluate.mean_contexts(items, "n").select("n_items", r6(F.col("mean_contexts")).alias("mean_contexts"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS at, left(props, 20) AS head FROM events")
def q_report_fields(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", T.utc(F.col("ts").cast("timestamp")).alias("at"), T.shortened(F.col("props"), 20).alias("head"))


@query(f"""WITH c AS (SELECT doc_id, regexp_matches(text, '{guard.EMAIL}') AS found, regexp_matches(text, '@mail[0-9]') AS truth FROM documents),
k AS (SELECT count(*) FILTER (found AND truth) AS tp, count(*) FILTER (found AND NOT truth) AS fp, count(*) FILTER (NOT found AND truth) AS fn FROM c)
SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM k""")
def q_pii_precision(spark: SparkSession, sf: str) -> DataFrame:
    """How the email rule does against documents with an address of the tables' mail hosts."""
    emails, _ = guard.contact_counts(F.col("text"))
    found = guard.precision_recall(table(spark, sf, "documents"), emails > 0, F.col("text").rlike("@mail[0-9]"))
    return found.select("tp", "fp", "fn", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


def _spans_sql(name: str, pattern: str) -> str:
    """Spans of a pattern: the lengths of the parts between its matches, and of these, added up."""
    return f"""
{name}_p AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '{pattern}'), lambda p: length(p)) AS b, list_transform(regexp_extract_all(text, '{pattern}'), lambda m: length(m)) AS m FROM documents),
{name} AS (SELECT DISTINCT doc_id, list_sum(b[1:i])::BIGINT + coalesce(list_sum(m[1:i - 1]), 0)::BIGINT AS s, list_sum(b[1:i])::BIGINT + list_sum(m[1:i])::BIGINT AS e FROM (SELECT doc_id, b, m, unnest(range(1, len(m) + 1)) AS i FROM {name}_p))"""


#: A label is a word around an at sign, as a reader would mark it: found by white space, not by what an address may hold.
_AT_WORD = r"[^\s@,;:()<>]+@[^\s@,;:()<>]+"


@query(f"""WITH {_spans_sql('f', guard.EMAIL)}, {_spans_sql('l', _AT_WORD)},
p AS (SELECT f.doc_id, f.s, f.e, l.s AS ls, l.e AS le, least(f.e, l.e) - greatest(f.s, l.s) AS shared FROM f JOIN l ON f.doc_id = l.doc_id AND f.s < l.e AND l.s < f.e),
g AS (SELECT *, shared / ((e - s) + (le - ls) - shared) AS part FROM p),
c AS (SELECT (SELECT count(*) FROM f) AS n_found, (SELECT count(*) FROM l) AS n_labelled,
  (SELECT count(*) FROM (SELECT 1 FROM g GROUP BY doc_id, s, e HAVING max(part) >= 0.9)) AS hits, (SELECT count(*) FROM (SELECT 1 FROM g GROUP BY doc_id, ls, le HAVING max(part) >= 0.9)) AS met)
SELECT *, round(hits / nullif(n_found, 0), 6) AS precision, round(met / nullif(n_labelled, 0), 6) AS recall FROM c""")
def q_pii_spans(spark: SparkSession, sf: str) -> DataFrame:
    """How the spans of the email rule meet the words with an at sign."""
    docs = table(spark, sf, "documents").select("doc_id", "text")

    def found(pattern: str) -> DataFrame:
        return docs.select("doc_id", F.explode(spans.matches(F.col("text"), pattern)).alias("s")).select("doc_id", "s.start", "s.end")

    scores = spans.span_scores(found(guard.EMAIL), found(_AT_WORD), "doc_id", 0.9)
    return scores.withColumns({c: r6(F.col(c)) for c in ("precision", "recall")})


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) <= 1 AS allowed FROM events")
def q_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return latency.rate_limited(table(spark, sf, "events"), "user_id", "ts", "event_id", 1).select("event_id", "allowed")


@query("SELECT conv_id, count(*) AS n_parts, sha256(string_agg(text, '' ORDER BY turn)) AS text_sha256 FROM conversations GROUP BY 1")
def q_token_assembly(spark: SparkSession, sf: str) -> DataFrame:
    from lexivec.streaming.events import assembled_text

    parts = table(spark, sf, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), F.col("text").alias("data"))
    return assembled_text(parts).select(F.col("request_id").alias("conv_id"), "n_parts", F.sha2("text", 256).alias("text_sha256"))


@query("""WITH e AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'retrieved' WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'done' ELSE 'token' END AS event FROM conversations),
p AS (SELECT *, lag(event) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM e)
SELECT conv_id, count(*) FILTER ((event = 'retrieved' AND before IS NOT NULL) OR (event <> 'retrieved' AND (before IS NULL OR before = 'done'))) AS violations FROM p GROUP BY 1""")
def q_event_order(spark: SparkSession, sf: str) -> DataFrame:
    from lexivec.streaming.events import order_violations

    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    event = F.when(F.col("turn") == 0, "retrieved").when(F.col("turn") == F.col("last"), "done").otherwise("token")
    events = turns.join(last, "conv_id").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), event.alias("event"))
    return order_violations(events).withColumnRenamed("request_id", "conv_id")


# Guardrails

EMAIL, PHONE, INJECTION = guard.EMAIL, guard.PHONE, guard.INJECTION


@query(f"""WITH r AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '{EMAIL}', '<EMAIL>', 'g'), '{PHONE}', '<PHONE>', 'g') AS red FROM documents)
SELECT doc_id, len(regexp_extract_all(text, '{EMAIL}'))::BIGINT AS n_emails, len(regexp_extract_all(text, '{PHONE}'))::BIGINT AS n_phones, sha256(red) AS redacted_sha256 FROM r""")
def q_pii_redact(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    emails, phones = guard.contact_counts(t)
    return table(spark, sf, "documents").select("doc_id", emails.alias("n_emails"), phones.alias("n_phones"), F.sha2(guard.masked(t), 256).alias("redacted_sha256"))


@query(f"SELECT role, count(*) AS n, count(*) FILTER (regexp_matches(text, '{INJECTION}')) AS flagged, round(avg(regexp_matches(text, '{INJECTION}')::INT), 6) AS rate, avg(regexp_matches(text, '{INJECTION}')::INT) <= 0.01 AS passes FROM conversations GROUP BY 1")
def q_injection_rate(spark: SparkSession, sf: str) -> DataFrame:
    return guard.flag_rate(table(spark, sf, "conversations"), guard.injected(F.col("text")), "role", 0.01)
