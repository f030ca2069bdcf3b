"""Queries on text, chunks, indexes and retrieval. Each document is one chunk, each benchmark item a question."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.config import DEFAULT
from lexivec.functions import scores as S
from lexivec.functions import text as T
from lexivec.operators import chunk, contain, index, retrieve, vector_store
from lexivec.plans.registry import query, table
from lexivec.sources.chunk_store import ChunkStore
from lexivec.sources.folders import materialize, new_folder, remove, shared_dir, state_of

WINDOW, OVERLAP = 128, 0.12
STEP = WINDOW - int(WINDOW * OVERLAP)

TOK = "regexp_extract_all(lower({}), '[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*')"


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text")


#: Indexes of this application by kind and table: the files that they were built from, their folder, and what reads them.
_INDEXES: dict[tuple[str, str, str], tuple[tuple, str, object]] = {}


def stored(spark: SparkSession, sf: str, kind: str, rows: DataFrame, build: Callable[[DataFrame, str], object]) -> object:
    """An index of rows that all queries share; it is built anew, and the old one removed, when the files of its table change."""
    key, state = (spark.sparkContext.applicationId, kind, sf), state_of(rows)
    known = _INDEXES.get(key)
    if not known or known[0] != state:
        if known:
            remove(spark, known[1])
        folder = f"{shared_dir(spark)}/lexivec-{kind}-{uuid.uuid4().hex}"
        _INDEXES[key] = known = (state, folder, build(rows, folder))
    return known[2]


def sparse_index(spark: SparkSession, sf: str) -> index.SparseIndex:
    return stored(spark, sf, "sparse", chunks(spark, sf), index.build_index)


def vector_index(spark: SparkSession, sf: str) -> vector_store.VectorIndex:
    return stored(spark, sf, "vectors", vectors(spark, sf), vector_store.build_vectors)


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))


def question_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select("qid").join(vectors(spark, sf).withColumnRenamed("key", "qid"), "qid")


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, key): the documents that hold a question's whole text."""
    return contain.containing(questions(spark, sf), chunks(spark, sf))


TOKENED = f"tok AS (SELECT doc_id, {TOK.format('text')} AS t FROM documents)"
GOLD_SQL = "gold AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
BM25_SQL = f"""
{TOKENED},
facts AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM tok),
ex AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok),
tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM ex GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, facts GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT item_id, generate_subscripts(t, 1) AS pos, unnest(t) AS term FROM (SELECT item_id, {TOK.format('text')} AS t FROM benchmark)),
scored AS (SELECT item_id, doc_id, round(sum(idf * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) ORDER BY pos), 9) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term), facts GROUP BY ALL),
pairs AS (SELECT item_id, doc_id, coalesce(score, 0.0) AS score FROM (SELECT item_id, doc_id FROM benchmark, documents) LEFT JOIN scored USING (item_id, doc_id)),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM pairs) WHERE rank <= 50)"""
DENSE_SQL = """
dense AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT item_id, v.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score
    FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings v)) WHERE rank <= 50)"""


def fused_sql(wd: str = "1.0", ws: str = "1.0", name: str = "pool") -> str:
    return f"""
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, dense_rank IS NULL, dense_rank, sparse_rank) AS pool_pos
  FROM (SELECT item_id, doc_id, d.rank AS dense_rank, s.rank AS sparse_rank, d.score AS dense, s.score AS sparse,
      round(coalesce({wd} / (60.0 + d.rank), 0.0) + coalesce({ws} / (60.0 + s.rank), 0.0), 12) AS fused
    FROM dense d FULL JOIN sparse s USING (item_id, doc_id))) WHERE pool_pos <= 50)"""


RERANK_SQL = f"""
asked AS (SELECT item_id, list_distinct({TOK.format('text')}) AS q FROM benchmark),
top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rerank DESC, pool_pos) AS pos
  FROM (SELECT p.*, round(coalesce(len(list_intersect(q, t))::DOUBLE / nullif(len(q), 0), 0.0), 9) AS rerank FROM pool p JOIN tok USING (doc_id) JOIN asked USING (item_id))) WHERE pos <= 5)"""
HYBRID_SQL = f"WITH {BM25_SQL}, {DENSE_SQL}, {fused_sql()}, {RERANK_SQL}, {GOLD_SQL}"


def ranked(df: DataFrame) -> DataFrame:
    return df.select(F.col("qid").alias("item_id"), F.col("key").alias("doc_id"), F.col("rank").cast("bigint").alias("rank"), S.rounded(F.col("score")).alias("score"))


def pooled(spark: SparkSession, sf: str, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    return retrieve.rrf(retrieve.dense_top(question_vectors(spark, sf), vectors(spark, sf)), retrieve.bm25_top(questions(spark, sf), sparse_index(spark, sf)), weights=weights)


def reranked(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.hybrid(questions(spark, sf), chunks(spark, sf), vectors(spark, sf), question_vectors(spark, sf), sparse=sparse_index(spark, sf))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The five best chunks by BM25 of every benchmark question, with their texts."""
    best = retrieve.bm25_top(questions(spark, sf), sparse_index(spark, sf), 5)
    return best.join(chunks(spark, sf), "key").select(F.col("qid").alias("item_id"), "rank", T.chunk_id(F.col("key"), F.lit(0)).alias("chunk_id"), "score", "text")


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, t[1] AS first_token FROM (SELECT doc_id, {TOK.format('text')} AS t FROM documents)")
def q_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"), F.get("t", F.lit(0)).alias("first_token"))


_SPLIT = "string_split(replace(regexp_replace(regexp_replace(text, '\\x{FEFF}', '', 'g'), '\\r\\n?', chr(10), 'g'), chr(12), ''), chr(10))"
_SPACE = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]"


@query(rf"""
WITH s AS (SELECT doc_id, list_filter({_SPLIT}, lambda x: NOT regexp_matches(x, '^.*\[Page \d+\]\s*$') AND NOT regexp_matches(x, '^RFC \d{{3,5}}\s{{2,}}.*\b(19|20)\d{{2}}\s*$')) AS l FROM documents),
j AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(l, lambda x: regexp_replace(x, '{_SPACE}+$', '')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g') AS b FROM s),
c AS (SELECT doc_id, regexp_replace(regexp_replace(b, '^{_SPACE}+', ''), '{_SPACE}+$', '') || chr(10) AS c FROM j)
SELECT doc_id, sha256(c) AS cleaned_sha256, len(string_split(c, chr(10)))::BIGINT AS n_lines FROM c""")
def q_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "documents").select("doc_id", T.clean(F.col("text")).alias("c"))
    return c.select("doc_id", F.sha2("c", 256).alias("cleaned_sha256"), F.size(F.split("c", "\n", -1)).cast("bigint").alias("n_lines"))


@query("""SELECT doc_id, source || '-' || lang AS title, 'https://corpus.example/' || source || '/' || doc_id || '.txt' AS source_uri, dense_rank() OVER (ORDER BY source) - 1 AS source_pos
FROM documents""")
def q_source_docs(spark: SparkSession, sf: str) -> DataFrame:
    from lexivec.sources.corpus import manifest_positions

    docs = table(spark, sf, "documents")
    listed = manifest_positions(docs.select("source").distinct())
    title = F.concat("source", F.lit("-"), "lang")
    uri = F.concat(F.lit("https://corpus.example/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.join(listed, "source").select("doc_id", title.alias("title"), uri.alias("source_uri"), "source_pos")


_WINDOWS = f"""
w AS (SELECT doc_id, unnest(range(0, greatest(ceil((len(t) - {WINDOW}) / {STEP}.0), 0)::BIGINT + 1)) AS ordinal, t FROM (SELECT doc_id, {TOK.format('text')} AS t FROM documents) WHERE len(t) > 0),
c AS (SELECT format('{{}}#{{:04d}}', doc_id, ordinal) AS chunk_id, doc_id, ordinal, t[ordinal * {STEP} + 1 : ordinal * {STEP} + {WINDOW}] AS t FROM w),
chunks AS (SELECT chunk_id, doc_id, ordinal, len(t)::BIGINT AS token_count, t FROM c WHERE len(t) >= 5)"""


def windows(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.token_windows(table(spark, sf, "documents").select("doc_id", "text"), WINDOW, OVERLAP)


@query(f"WITH {_WINDOWS} SELECT chunk_id, doc_id, ordinal, token_count FROM chunks")
def q_chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows(spark, sf).select("chunk_id", "doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("token_count").cast("bigint").alias("token_count"))


@query()
def q_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.recursive_chunks(table(spark, sf, "documents").select("doc_id", "text")).drop("text")


def _window_chunks(docs: DataFrame) -> DataFrame:
    """A chunker of token windows: chunks whose text is their tokens."""
    return chunk.token_windows(docs, WINDOW, OVERLAP).select("chunk_id", "doc_id", F.array_join("tokens", " ").alias("text"), "token_count", "ordinal")


@query(f"""WITH documents AS (SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN text || ' revised edition' ELSE text END AS text FROM main.documents WHERE doc_id % 100 <> 8), {_WINDOWS}
SELECT chunk_id, doc_id::VARCHAR AS doc_id, ordinal, token_count, sha256(array_to_string(t, ' ')) AS text_sha256 FROM chunks""")
def q_ingest_delta(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk store after an ingest of all documents and a second one, for which one in a hundred has changed and one is gone."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    store = ChunkStore(spark, new_folder(spark, "store"), buckets=256, chunker=_window_chunks)
    store.ingest(docs)
    revised = F.when(F.col("doc_id") % 100 == 7, F.concat("text", F.lit(" revised edition"))).otherwise(F.col("text"))
    store.ingest(docs.where("doc_id % 100 != 8").withColumn("text", revised))
    return store.chunks().select("chunk_id", "doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("token_count").cast("bigint").alias("token_count"), F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH {_WINDOWS} SELECT count(*) AS n_chunks, round(coalesce(avg(token_count), 0.0), 6) AS mean_tokens, coalesce(min(token_count), 0) AS min_tokens, coalesce(max(token_count), 0) AS max_tokens FROM chunks")
def q_chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.chunk_stats(windows(spark, sf)).withColumn("mean_tokens", S.rounded(F.col("mean_tokens")))


@query(f"WITH {_WINDOWS} SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM chunks) GROUP BY ALL")
def q_postings(spark: SparkSession, sf: str) -> DataFrame:
    return index.postings(windows(spark, sf), "chunk_id")


@query(f"""WITH {_WINDOWS},
raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM chunks) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM (SELECT unnest(list_distinct(t)) AS term FROM chunks) GROUP BY term)
SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END, 6) AS idf FROM raw""")
def q_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    w = materialize(windows(spark, sf).select("tokens"))
    return index.idf(materialize(index.document_frequency(w)), w.count()).withColumn("idf", S.rounded(F.col("idf")))


@query("SELECT vec_id, len(embedding)::BIGINT AS dim, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def q_dense_index(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return v.select("vec_id", F.size("embedding").cast("bigint").alias("dim"), S.rounded(F.sqrt(S.dot(F.col("embedding"), F.col("embedding")))).alias("norm"))


@query("SELECT vec_id, 1.0::DOUBLE AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def q_normalize(spark: SparkSession, sf: str) -> DataFrame:
    scaled = table(spark, sf, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3).alias("v"))
    unit = index.dense_index(scaled, "vec_id", "v")
    return unit.select("vec_id", S.rounded(F.sqrt(S.dot(F.col("embedding"), F.col("embedding")))).alias("norm"), S.rounded(F.col("embedding")[0]).alias("first"))


@query("SELECT (SELECT count(*) FROM documents) AS doc_count, (SELECT count(*) FROM documents) AS chunk_count, (SELECT max(len(embedding)) FROM embeddings)::BIGINT AS dim, 'recursive' AS chunk_strategy")
def q_index_meta(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return index.index_meta(docs, docs, table(spark, sf, "embeddings"), "embedding")


@query("""WITH a AS (SELECT doc_id AS key, count(*) AS a FROM documents GROUP BY 1), b AS (SELECT vec_id AS key, count(*) AS b FROM embeddings GROUP BY 1)
SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS matched, count(*) FILTER (b IS NULL) AS only_left, count(*) FILTER (a IS NULL) AS only_right,
  sum(coalesce(a - 1, 0) + coalesce(b - 1, 0))::BIGINT AS duplicates FROM a FULL JOIN b USING (key)""")
def q_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return index.alignment(chunks(spark, sf), vectors(spark, sf), "key")


@query(f"WITH {BM25_SQL} SELECT item_id, doc_id, rank, round(score, 6) AS score FROM sparse")
def q_bm25_topn(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(retrieve.bm25_top(questions(spark, sf), sparse_index(spark, sf)))


@query(f"""WITH {_WINDOWS}, {BM25_SQL.replace(TOKENED, 'tok AS (SELECT chunk_id AS doc_id, t FROM chunks)').replace('FROM benchmark, documents)', 'FROM benchmark, tok)')}
SELECT item_id, doc_id AS chunk_id, rank, round(score, 6) AS score FROM sparse""")
def q_bm25_windows(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 lists of token windows in place of whole documents."""
    cut = windows(spark, sf).select(F.col("chunk_id").alias("key"), "tokens")
    return ranked(retrieve.bm25_top(questions(spark, sf), stored(spark, sf, "windows", cut, index.build_index))).withColumnRenamed("doc_id", "chunk_id")


@query(f"WITH {DENSE_SQL} SELECT item_id, doc_id, rank, round(score, 6) AS score FROM dense")
def q_dense_topn(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(retrieve.dense_top(question_vectors(spark, sf), vectors(spark, sf)))


@query(f"WITH {DENSE_SQL} SELECT item_id, doc_id, rank, round(score, 6) AS score FROM dense")
def q_dense_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The dense lists again, from the stored index of cells."""
    return ranked(vector_store.dense_stored_top(question_vectors(spark, sf), vector_index(spark, sf)))


def pool_rows(pool: DataFrame) -> DataFrame:
    ints = [F.col(c).cast("bigint").alias(c) for c in ("dense_rank", "sparse_rank", "pool_pos")]
    return pool.select(F.col("qid").alias("item_id"), F.col("key").alias("doc_id"), *ints, S.rounded(F.col("fused"), 9).alias("fused"))


@query(f"WITH {BM25_SQL}, {DENSE_SQL}, {fused_sql()} SELECT item_id, doc_id, dense_rank, sparse_rank, pool_pos, round(fused, 9) AS fused FROM pool")
def q_rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return pool_rows(pooled(spark, sf))


@query(f"WITH {BM25_SQL}, {DENSE_SQL}, {fused_sql('0.5', '0.5')} SELECT item_id, doc_id, dense_rank, sparse_rank, pool_pos, round(fused, 9) AS fused FROM pool")
def q_weighted_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return pool_rows(pooled(spark, sf, (0.5, 0.5)))


@query(f"{HYBRID_SQL} SELECT item_id, doc_id, pos, round(rerank, 6) AS rerank FROM top5")
def q_rerank(spark: SparkSession, sf: str) -> DataFrame:
    best = retrieve.rerank(pooled(spark, sf), questions(spark, sf), chunks(spark, sf))
    return best.select(F.col("qid").alias("item_id"), F.col("key").alias("doc_id"), F.col("pos").cast("bigint").alias("pos"), S.rounded(F.col("rerank")).alias("rerank"))


_FOUR = "round(dense, 6) AS dense, round(sparse, 6) AS sparse, round(fused, 9) AS fused, round(rerank, 6) AS rerank"


def four(df: DataFrame) -> DataFrame:
    for c, d in (("dense", 6), ("sparse", 6), ("fused", 9), ("rerank", 6)):
        df = df.withColumn(c, S.rounded(F.col(c), d))
    return df.withColumn("pos", F.col("pos").cast("bigint")).withColumn("chunk_id", T.chunk_id(F.col("key"), F.lit(0))).withColumnRenamed("qid", "item_id")


@query(f"{HYBRID_SQL} SELECT item_id, format('{{}}#0000', doc_id) AS chunk_id, {_FOUR}, pos FROM top5")
def q_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return four(reranked(spark, sf)).select("item_id", "chunk_id", "dense", "sparse", "fused", "rerank", "pos")


@query(f"{HYBRID_SQL} SELECT item_id, format('{{}}#0000', doc_id) AS chunk_id, doc_id::VARCHAR AS doc_id, {_FOUR} FROM top5")
def q_retrieved_payload(spark: SparkSession, sf: str) -> DataFrame:
    return four(reranked(spark, sf)).select("item_id", "chunk_id", T.doc_of(F.col("chunk_id")).alias("doc_id"), "dense", "sparse", "fused", "rerank")


@query(f"""{HYBRID_SQL}
SELECT item_id, min(d.rank) AS dense_rank, min(s.rank) AS sparse_rank, min(pos) AS hybrid_pos, min(pos) IS NOT NULL AND min(d.rank) IS NULL AS recovered
FROM gold g LEFT JOIN dense d USING (item_id, doc_id) LEFT JOIN sparse s USING (item_id, doc_id) LEFT JOIN top5 t USING (item_id, doc_id) GROUP BY item_id""")
def q_exact_match_recovery(spark: SparkSession, sf: str) -> DataFrame:
    dense = materialize(retrieve.dense_top(question_vectors(spark, sf), vectors(spark, sf)))
    sparse = materialize(retrieve.bm25_top(questions(spark, sf), sparse_index(spark, sf)))
    best = retrieve.rerank(retrieve.rrf(dense, sparse), questions(spark, sf), chunks(spark, sf))
    found = gold(spark, sf)
    for df, c, name in ((dense, "rank", "dense_rank"), (sparse, "rank", "sparse_rank"), (best, "pos", "hybrid_pos")):
        found = found.join(df.select("qid", "key", F.col(c).cast("bigint").alias(name)), ["qid", "key"], "left")
    ranks = [F.min(c).alias(c) for c in ("dense_rank", "sparse_rank", "hybrid_pos")]
    return found.groupBy(F.col("qid").alias("item_id")).agg(*ranks).withColumn("recovered", F.col("hybrid_pos").isNotNull() & F.col("dense_rank").isNull())


@query(f"""{HYBRID_SQL},
r AS (SELECT item_id, sum((p.pool_pos IS NOT NULL)::INT) / count(*) AS fusion, sum((t.pos IS NOT NULL)::INT) / count(*) AS reranked
  FROM gold LEFT JOIN (SELECT * FROM pool WHERE pool_pos <= 5) p USING (item_id, doc_id) LEFT JOIN top5 t USING (item_id, doc_id) GROUP BY item_id)
SELECT item_id, round(fusion, 6) AS fusion_recall, round(reranked, 6) AS rerank_recall, round(reranked - fusion, 6) AS delta FROM r""")
def q_recall_delta(spark: SparkSession, sf: str) -> DataFrame:
    pool, truth = materialize(pooled(spark, sf)), materialize(gold(spark, sf))
    best = retrieve.rerank(pool, questions(spark, sf), chunks(spark, sf))
    k = DEFAULT.rerank_top_k
    a = retrieve.recall_at(pool, truth, k, "pool_pos").withColumnRenamed("recall", "fusion")
    b = retrieve.recall_at(best, truth, k, "pos").withColumnRenamed("recall", "reranked")
    both = a.join(b, "qid")
    return both.select(F.col("qid").alias("item_id"), S.rounded(F.col("fusion")).alias("fusion_recall"), S.rounded(F.col("reranked")).alias("rerank_recall"), S.rounded(F.col("reranked") - F.col("fusion")).alias("delta"))


@query(f"""WITH scoped AS (SELECT doc_id, text FROM documents WHERE lang = 'en'),
{BM25_SQL.replace('FROM documents)', 'FROM scoped)').replace('FROM benchmark, documents)', 'FROM benchmark, scoped)')}
SELECT item_id, doc_id, rank, round(score, 6) AS score FROM sparse WHERE rank <= 5""")
def q_scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    allowed = spark.createDataFrame([("en",)], "lang string")
    seen = retrieve.within_scope(docs, allowed, "lang").select(F.col("doc_id").alias("key"), "text")
    return ranked(retrieve.bm25_top(questions(spark, sf), seen, 5))
