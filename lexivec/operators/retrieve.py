"""Ranked retrieval of many questions at once. Scores are rounded to nine digits before they rank, so that ties are ties
on any machine; ties go by the chunk's key, which is the canonical order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivec.config import DEFAULT, Config
from lexivec.functions import text as T
from lexivec.operators.index import BLOCK, UNIT, SparseIndex, build_index
from lexivec.operators.meet import meet, partitions_of, small_batches
from lexivec.operators.vector_store import Scan
from lexivec.sources.folders import materialize, new_folder

#: Questions that the dense scan sends to all tasks at most, and the bytes that their matrix may have; vectors that a task holds
#: where there are more.
QUESTION_BLOCK, BLOCK_BYTES, VECTORS = 4096, 64 << 20, 65_536
#: The leading terms of a question have about so many postings for each chunk that is asked for.
LEADING_POSTINGS = 20
#: Scores that differ by fewer units can be equal once they are rounded, and one of more is above 0.
SLACK = int(1.1e-9 / UNIT)


def top(scored: DataFrame, n: int, *order: Column, by: str = "qid", rank: str = "rank") -> DataFrame:
    """The first n rows of each question with their rank; rows are pruned before they are shuffled."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= n)


def question_terms(questions: DataFrame) -> DataFrame:
    """(qid, pos, term) of questions (qid, question), repeated terms kept."""
    return questions.select("qid", F.posexplode(T.tokens(F.col("question"))).alias("pos", "term"))


def _weighed(questions: DataFrame, sparse: SparseIndex) -> DataFrame:
    """(qid, term, df, idf, times, most): each distinct term of a question that the index has."""
    found = question_terms(questions).groupBy("qid", "term").agg(F.count("*").alias("times")).join(sparse.terms, "term")
    return found.withColumn("most", F.greatest(F.col("most") * F.col("times"), F.lit(0)))


def _summed(terms: DataFrame, sparse: SparseIndex) -> DataFrame:
    """(qid, segment, doc, units) of the chunks with any of the terms (qid, term, idf, times), each pair a row; summed before
    the shuffle. For few postings."""
    each = terms.join(sparse.postings.select("segment", "term", "docs", "weights"), "term")
    parts = each.select("qid", "segment", "idf", "times", F.explode(F.arrays_zip("docs", "weights")).alias("p"))
    units = F.round(F.col("idf") * F.col("p.weights") / UNIT).cast("bigint") * F.col("times")
    return parts.groupBy("qid", "segment", F.col("p.docs").alias("doc")).agg(F.sum(units).alias("units"))


def _keyed(scored: DataFrame, sparse: SparseIndex) -> DataFrame:
    """(qid, key, score) of (qid, segment, doc, units)."""
    return scored.join(sparse.keys, ["segment", "doc"]).select("qid", "key", F.round(F.col("units") * UNIT, 9).alias("score"))


def bm25_scores(questions: DataFrame, sparse: SparseIndex) -> DataFrame:
    """(qid, key, score) of the chunks that share a term with the question, all of them."""
    return _keyed(_summed(_weighed(questions, sparse), sparse), sparse)


class SegmentScorer:
    """Scores questions in one segment of the index: blocks of chunks in the order of their bounds, until none can reach the
    n-th score."""

    def __init__(self, n: int):
        self.n, self.lists = n, {}
        self.slack = SLACK

    def hold(self, rows: pd.DataFrame) -> None:
        for term, docs, weights, blocks, maxima in rows.itertuples(index=False, name=None):
            # A block that lay at the edge of two parts is there twice.
            blocks, maxima = np.asarray(blocks, np.int64), np.asarray(maxima)
            fresh = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
            if len(fresh) < len(blocks):
                blocks, maxima = blocks[fresh], np.maximum.reduceat(maxima, fresh)
            self.lists[term] = (np.asarray(docs, np.int64), np.asarray(weights), blocks, maxima)

    def ask(self, rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in ("qid", "doc", "units", "blocks_read", "scored")}
        for qid, terms, times, idfs, bound, bounded in rows.itertuples(index=False, name=None):
            docs, units, read, scored = self.best(terms, times, idfs, int(bound) if bounded else None)
            out["qid"] += [qid] * max(1, len(docs))
            out["doc"] += docs.tolist() or [-1]
            out["units"] += units.tolist() or [0]
            out["blocks_read"] += [read] + [0] * (len(docs) - 1)
            out["scored"] += [scored] + [0] * (len(docs) - 1)
        return pd.DataFrame(out)

    def best(self, terms, times, idfs, bound: int | None) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(chunks, units, blocks read, chunks scored): those that can be among the n best of all segments, and all that match
        where fewer than n of them have a score above 0."""
        found = [(*self.lists[t], i, int(k)) for t, k, i in zip(terms, times, idfs, strict=True) if t in self.lists]
        none = np.zeros(0, np.int64)
        if not found:
            return none, none, 0, 0

        def units(weights: np.ndarray, idf: float, k: int) -> np.ndarray:
            return np.rint(idf * weights / UNIT).astype(np.int64) * k

        tops = [np.maximum(units(m, i, k), 0) for _, _, _, m, i, k in found]
        order = sorted(range(len(found)), key=lambda x: int(tops[x].max()))
        found, tops = [found[x] for x in order], [tops[x] for x in order]
        n_blocks = max(int(f[2][-1]) for f in found) + 1
        # Bounds by block: of all terms, and of the lightest ones so far.
        light = np.zeros((len(found) + 1, n_blocks), np.int64)
        for x, (f, t) in enumerate(zip(found, tops, strict=True)):
            light[x + 1] = light[x]
            light[x + 1][f[2]] += t
        total, lightest = light[-1], np.concatenate([[0], np.cumsum([int(t.max()) for t in tops])])
        starts = [np.searchsorted(f[0], f[2] * BLOCK) for f in found]
        sizes = [np.diff(np.append(s, len(f[0]))) for s, f in zip(starts, found, strict=True)]
        present = np.zeros(n_blocks, bool)
        for f in found:
            present[f[2]] = True
        blocks = np.flatnonzero(present)
        blocks = blocks[np.argsort(-total[blocks], kind="stable")]
        kept, values, low, read, scored, at, step = none, none, bound, 0, 0, 0, 64
        while at < len(blocks):
            some = blocks[at : at + step]
            at, step = at + step, 2 * step
            if low is not None:
                some = some[total[some] >= low - self.slack]
                if not len(some):
                    break
            read += len(some)
            # A chunk that has only the lightest terms, which together stay below the n-th score, can't be in the list.
            first = 0 if low is None else int(np.searchsorted(lightest, low - self.slack, side="left")) - 1
            first = min(max(first, 0), len(found) - 1)
            where = np.full(n_blocks, -1, np.int64)
            where[some] = np.arange(len(some))
            sums, hit = np.zeros(len(some) * BLOCK, np.int64), np.zeros(len(some) * BLOCK, bool)

            def add(x: int, only: np.ndarray | None = None, where=where, sums=sums, hit=hit) -> None:
                docs, weights, own, _, idf, k = found[x]
                mine = np.flatnonzero(where[own] >= 0)
                n = sizes[x][mine]
                which = np.repeat(starts[x][mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                to = np.repeat(where[own[mine]] * BLOCK, n) + docs[which] % BLOCK
                if only is not None:
                    which, to = which[only[to]], to[only[to]]
                sums[to] += units(weights[which], idf, k)
                hit[to] = True

            for x in range(len(found) - 1, first - 1, -1):
                add(x)
            # Of the lightest terms a block's bound counts: only chunks that can still reach the n-th score are scored in full.
            live = hit if low is None else hit & (sums + np.repeat(light[first][some], BLOCK) >= low - self.slack)
            for x in range(first - 1, -1, -1):
                if low is not None:
                    live = live & (sums + np.repeat(light[x + 1][some], BLOCK) >= low - self.slack)
                add(x, live)
            scored += int(live.sum())
            chosen = np.flatnonzero(live)
            kept = np.concatenate([kept, some[chosen // BLOCK] * BLOCK + chosen % BLOCK])
            values = np.concatenate([values, sums[chosen]])
            if len(values) >= self.n:
                nth = int(np.partition(values, len(values) - self.n)[len(values) - self.n])
                if nth > self.slack:
                    low = nth if low is None else max(low, nth)
        if low is not None:
            near = values >= low - self.slack
            kept, values = kept[near], values[near]
            # Of equal sums the first n chunks are enough.
            by = np.lexsort((kept, -values))
            kept, values = kept[by], values[by]
            fresh = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else none
            place = np.arange(len(values)) - np.repeat(fresh, np.diff(np.append(fresh, len(values))))
            kept, values = kept[place < self.n], values[place < self.n]
        return kept, values, read, scored


def bm25_top(questions: DataFrame, sparse: SparseIndex | DataFrame, n: int | None = None, config: Config = DEFAULT, report: list[DataFrame] | None = None) -> DataFrame:
    """(qid, key, rank, score), n for each question, from an index or from chunks (key, text), of which one is built first
    in the shared folder.

    A question with fewer matches of a score above 0 is filled up with chunks of score 0 in canonical order, whether they match or
    not; matches with a negative score rank after these.

    The n-th best sum over a question's weightiest terms is a bound that every chunk of its list reaches. Questions then meet
    the postings of their terms segment by segment, where blocks of chunks are read in the order of the sums of their maxima until
    none can reach the bound, and only chunks that can are scored in full and leave the task. Sums are exact, and so is the
    list. `report` gets the table whose columns blocks_read and scored count the blocks and chunks that each question met."""
    n = n or config.sparse_top_n
    if isinstance(sparse, DataFrame):
        sparse = build_index(sparse, new_folder(questions.sparkSession, "index"), config)
    asked = questions.select("qid").distinct()
    heavy = Window.partitionBy("qid").orderBy(F.col("most").desc(), "term").rowsBetween(Window.unboundedPreceding, -1)
    terms = materialize(_weighed(questions, sparse).withColumn("heavier", F.coalesce(F.sum("df").over(heavy), F.lit(0))))
    lowest = sparse.terms.agg(F.min("idf")).first()[0] or 0.0
    leading = materialize(terms.where((F.col("heavier") + F.col("df") <= LEADING_POSTINGS * n) & F.lit(lowest >= 0)))
    first = _summed(leading, sparse)
    bound = top(first, n, F.col("units").desc(), F.col("segment"), F.col("doc")).where((F.col("rank") == n) & (F.col("units") > SLACK)).select("qid", F.col("units").alias("bound"))
    lists = terms.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", "times", "idf"))).alias("t"))
    asking = lists.join(bound, "qid", "left").select(
        "qid", F.col("t.term").alias("terms"), F.col("t.times").alias("times"), F.col("t.idf").alias("idfs"), F.coalesce("bound", F.lit(0)).alias("bound"), F.col("bound").isNotNull().alias("bounded")
    )
    # A segment is asked by the questions that have one of its terms.
    held = sparse.postings.join(terms.select("term").distinct(), "term", "left_semi").select("segment", "term", "docs", "weights", "blocks", "maxima")
    segments = sparse.postings.join(terms.select("qid", "term"), "term").select("segment", "qid").distinct()
    kind = questions.schema["qid"].dataType.simpleString()
    met = meet(held, materialize(segments.join(asking, "qid")), "segment", lambda: SegmentScorer(n), f"segment bigint, qid {kind}, doc int, units bigint, blocks_read bigint, scored bigint")
    with small_batches(questions.sparkSession):
        met = materialize(met)
    if report is not None:
        report.append(met)
    scored = _keyed(met.where("doc >= 0"), sparse)
    filled = asked.join(scored.groupBy("qid").agg(F.count("*").alias("matched"), F.count_if(F.col("score") > 0).alias("good")), "qid", "left").select("qid", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("matched", "good")])
    short = filled.where(F.col("good") < n)
    depth = short.agg(F.max("matched")).first()[0]
    if depth is not None:
        # Of the first n + matched chunks at least n do not match, so that many are enough for each question.
        spare = sparse.keys.select("key").orderBy("key").limit(n + depth).withColumn("place", F.row_number().over(Window.orderBy("key")))
        places = short.select("qid", F.explode(F.sequence(F.lit(1), (F.col("matched") + n).cast("int"))).alias("place"))
        spare = places.join(spare, "place").select("qid", "key").join(scored, ["qid", "key"], "left_anti").withColumn("score", F.lit(0.0))
        scored = scored.unionByName(spare)
    return top(scored, n, F.col("score").desc(), F.col("key"))


def dense_top(questions: DataFrame, vectors: DataFrame, n: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """(qid, key, rank, score) by inner product of questions (qid, vector) and vectors (key, vector), n for each question.

    Questions that fit in one block (QUESTION_BLOCK, and BLOCK_BYTES as a matrix) go to the tasks as one matrix, which meets
    each batch of vectors in one product; only the best n of a batch leave it, with all that tie with the last of them. More
    questions than that are never collected: they meet the vectors in the tasks of VECTORS of these each. A null vector has no
    score. To search the same vectors again, store them (vector_store)."""
    n = n or config.dense_top_n
    kind_q, kind_k = questions.schema["qid"].dataType.simpleString(), vectors.schema["key"].dataType.simpleString()
    asked = materialize(questions.where("vector is not null").select("qid", F.col("vector").cast("array<double>").alias("v")))
    held = vectors.where("vector is not null").select("key", F.col("vector").cast("array<double>").alias("vector"))
    facts = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    if facts["n"] <= min(QUESTION_BLOCK, BLOCK_BYTES // (8 * max(1, facts["dim"] or 1))):
        rows = asked.collect()
        ids, matrix = [r["qid"] for r in rows], np.array([r["v"] for r in rows], float)

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf) or not len(ids):
                    continue
                products = np.round(np.stack(pdf["vector"]) @ matrix.T, 9)
                keys, m = pdf["key"].to_numpy(), min(n, len(pdf))
                least = np.partition(products, len(pdf) - m, axis=0)[len(pdf) - m]
                i, j = np.nonzero(products >= least)
                yield pd.DataFrame({"qid": [ids[x] for x in j], "key": keys[i], "score": products[i, j]})

        found = held.mapInPandas(best, f"qid {kind_q}, key {kind_k}, score double")
    else:
        places = max(partitions_of(vectors), math.ceil(held.count() / VECTORS))
        every = asked.select("qid", F.col("v").alias("question"), F.lit(float("-inf")).alias("low"), F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("place"))
        dealt = held.withColumn("place", F.pmod(F.xxhash64("key"), F.lit(places)).cast("int"))
        found = meet(dealt, every, "place", lambda: Scan(n), f"place int, qid {kind_q}, key {kind_k}, score double").drop("place")
    return top(found, n, F.col("score").desc(), F.col("key"))


def rrf(dense: DataFrame, sparse: DataFrame, k: int | None = None, pool: int | None = None, weights: tuple[float, float] = (1.0, 1.0), config: Config = DEFAULT) -> DataFrame:
    """(qid, key, dense_rank, sparse_rank, dense, sparse, fused, pool_pos): reciprocal ranks of both lists added up.

    Equal sums go by dense rank, then those that only the sparse list has by sparse rank. k = 0 is honoured."""
    k = config.rrf_k if k is None else k
    a = dense.select("qid", "key", F.col("rank").alias("dense_rank"), F.col("score").alias("dense"))
    b = sparse.select("qid", "key", F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse"))

    def share(rank: str, w: float) -> Column:
        return F.coalesce(F.lit(w) / (F.lit(float(k)) + F.col(rank)), F.lit(0.0))

    both = a.join(b, ["qid", "key"], "full_outer").withColumn("fused", F.round(share("dense_rank", weights[0]) + share("sparse_rank", weights[1]), 12))
    order = (F.col("fused").desc(), F.col("dense_rank").isNull(), F.col("dense_rank"), F.col("sparse_rank"))
    return top(both, pool or config.pool_size, *order, rank="pool_pos")


def fuse_many(lists: list[DataFrame], k: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """(qid, key, fused) over any number of ranked lists (qid, key, rank)."""
    k = config.rrf_k if k is None else k
    every = lists[0].select("qid", "key", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("qid", "key", "rank"))
    ordered = F.array_sort(F.collect_list(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))))
    return every.groupBy("qid", "key").agg(F.aggregate(ordered, F.lit(0.0), lambda s, x: s + x).alias("fused"))


def lexical_scorer(question: Column, text: Column) -> Column:
    """The part of the question's distinct tokens that the text has; the default in place of a model."""
    asked = F.array_distinct(T.tokens(question))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, T.tokens(text))).cast("double"), F.size(asked)), F.lit(0.0))


def rerank(pool: DataFrame, questions: DataFrame, chunks: DataFrame, k: int | None = None, scorer=lexical_scorer, config: Config = DEFAULT) -> DataFrame:
    """pool with text, rerank and pos: the best k of each question by scorer(question, text); ties keep the pool's order.

    Texts are joined only now, for the pool. k of 0 or None is the default; a negative k is an error."""
    if k is not None and k < 0:
        raise ValueError("k must not be negative")
    texts = pool.join(chunks.select("key", "text"), "key").join(questions.select("qid", "question"), "qid")
    scored = texts.withColumn("rerank", F.round(scorer(F.col("question"), F.col("text")), 9))
    return top(scored, k or config.rerank_top_k, F.col("rerank").desc(), F.col("pool_pos"), rank="pos").drop("question")


def hybrid(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, question_vectors: DataFrame, k: int | None = None, scorer=lexical_scorer, config: Config = DEFAULT, sparse: SparseIndex | None = None) -> DataFrame:
    """Dense and sparse lists, fused, then reranked: (qid, key, dense, sparse, fused, rerank, pos, text, ...)."""
    pool = rrf(dense_top(question_vectors, vectors, config=config), bm25_top(questions, sparse or chunks, config=config), config=config)
    return rerank(pool, questions, chunks, k, scorer, config)


def within_scope(chunks: DataFrame, allowed: DataFrame, on: str) -> DataFrame:
    """Only chunks that the caller may see; applied before any ranking."""
    return chunks.join(allowed.select(on).distinct(), on, "left_semi")


def recall_at(ranked: DataFrame, gold: DataFrame, k: int, rank: str) -> DataFrame:
    """(qid, recall) of ranked lists against gold (qid, key), for the questions that have gold."""
    hits = gold.join(ranked.where(F.col(rank) <= k).select("qid", "key").withColumn("hit", F.lit(1)), ["qid", "key"], "left")
    return hits.groupBy("qid").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
