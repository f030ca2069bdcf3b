"""Exact top-k by inner product: blocks of documents with the maxima of their terms, scored until no bound can reach the k-th.

A component of a vector is two terms, its positive and its negative part, so that a block's bound for a query is a sum of
term maxima whatever the signs. Blocks lie in ranges of documents, and so do segments, runs of blocks that one task
holds; both have maxima. A query first goes to the segment with the highest bound, which gives it a k-th score, and then
to all others that may hold more; there it meets blocks in the order of their bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.common import partitions_of
from lexivec.llm.vectors import LONG, finite, floors, products, rows, tight
from lexivec.sources.folders import materialize

SCALE, TOP = 1024, 10
#: Documents of a block; bytes of a segment's vectors, in 2 bytes a component; bytes of the segments' maxima, which every
#: task gets. Segments grow only where there are more than the last allows (at 64 components: over 4 billion vectors).
BLOCK, SEGMENT_BYTES, MAXIMA_BYTES = 256, 32 << 20, 64 << 20
#: Queries that a task scores at once.
BATCH = 2048
_NONE = -LONG - 1  # below every score

_INDEX = "segment int, first bigint, n int, ids array<string>, asked array<int>, v binary, maxima binary"
_ROUTE = "segment int, slice int, query bigint, query_id string, q binary, kth bigint, kth_doc bigint, docs array<bigint>"


def _maxima(x: np.ndarray) -> np.ndarray:
    """The term maxima of rows: the highest of each component, then of its negative, none below 0, as absent terms are 0."""
    return np.concatenate([x.max(axis=0, initial=0), (-x).max(axis=0, initial=0)])


def _terms(q: np.ndarray) -> np.ndarray:
    """The weights of a query's terms: its positive parts, then its negative ones."""
    return np.concatenate([np.maximum(q, 0), np.maximum(-q, 0)], axis=1)


class Index:
    """Blocks (rows with n > 0) and, for each segment, a row with its maxima (n = 0)."""

    def __init__(self, table: DataFrame, width: int, segments: int):
        self.table, self.width, self.segments = table, width, segments

    def maxima(self) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, maxima) of the segments that have documents; at most MAXIMA_BYTES."""
        found = sorted((r["segment"], bytes(r["maxima"])) for r in self.table.where("n = 0").select("segment", "maxima").collect())
        return np.array([s for s, _ in found], np.int64), np.array([np.frombuffer(m, "<i8") for _, m in found]).reshape(len(found), 2 * self.width)


def build(vectors: DataFrame, asks: Column, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> Index:
    """The index of the finite vectors: documents are numbered by id (nulls last), dealt by ranges of that, cut into blocks.

    `asks` tells which rows are queries as well; null is no. Shorter vectors have zeros at their end. A third key, the place of a
    row, lets even rows of one id lie in several segments."""
    good = vectors.where(finite(F.col(vector)))
    size = good.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("width")).first()
    width = size["width"]
    segments = max(partitions_of(vectors), math.ceil(size["n"] * max(1, width) * 2 / SEGMENT_BYTES))
    segments = max(1, min(segments, MAXIMA_BYTES // max(1, 16 * width), math.ceil(size["n"] / 8)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment = TaskContext.get().partitionId()
        first, top, held = segment << 40, np.zeros(2 * width, np.int64), []

        def rows_of(parts: list[pd.DataFrame], all: bool) -> Iterator[tuple]:
            nonlocal first, top
            pdf = pd.concat(parts, ignore_index=True)
            end = len(pdf) if all else len(pdf) // BLOCK * BLOCK
            for at in range(0, end, BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                lengths = np.fromiter(map(len, part["v"]), np.int64, len(part))
                x = np.zeros((len(part), width), np.int64)
                x[np.arange(width) < lengths[:, None]] = floors(np.concatenate(part["v"].to_list()), scale)
                most = _maxima(x)
                top = np.maximum(top, most)
                yield segment, first, len(part), part["id"].to_list(), np.flatnonzero(part["asks"]).tolist(), tight(x).tobytes(), most.astype("<i8").tobytes()
                first += len(part)
            parts[:] = [pdf.iloc[end:]]

        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= BLOCK:
                yield pd.DataFrame(list(rows_of(held, False)), columns=columns)
        if held:
            rest = list(rows_of(held, True))
            yield pd.DataFrame([*rest, (segment, -1, 0, [], [], b"", top.astype("<i8").tobytes())], columns=columns)

    columns = [c.split()[0] for c in _INDEX.split(", ")]
    keyed = good.select(F.col(id).alias("key"), F.monotonically_increasing_id().alias("place"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(vector).cast("array<double>").alias("v"))
    order = [F.col("key").asc_nulls_last(), F.col("place")]
    dealt = keyed.repartitionByRange(segments, *order).sortWithinPartitions(*order)
    return Index(materialize(dealt.select(F.col("key").cast("string").alias("id"), "asks", "v").mapInPandas(cut, _INDEX)), width, segments)


def queries(index: Index) -> DataFrame:
    """(query, query_id, q): number, id and vector of the documents that ask."""
    width = index.width

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for first, n, ids, asked, v in zip(pdf["first"], pdf["n"], pdf["ids"], pdf["asked"], pdf["v"], strict=True):
                x = rows([v], width * n).reshape(n, width)[asked]
                out += [(int(first) + int(a), ids[a], q.tobytes()) for a, q in zip(asked, tight(x), strict=True)]
            yield pd.DataFrame(out, columns=["query", "query_id", "q"])

    return index.table.where("n > 0 and size(asked) > 0").mapInPandas(run, "query bigint, query_id string, q binary")


def _routed(asking: DataFrame, index: Index, first: bool) -> DataFrame:
    """Queries with the segments that they go to: the one with the highest bound, or the others that may hold more than kth."""
    numbers, maxima = index.maxima()
    sent, width = asking.sparkSession.sparkContext.broadcast((numbers, maxima)), index.width
    columns = [c.split()[0] for c in _ROUTE.split(", ") if "slice" not in c and "docs" not in c]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, maxima = sent.value
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                pdf = whole.iloc[at : at + BATCH].reset_index(drop=True)
                bound = products(_terms(rows(pdf["q"], width)), maxima)
                best = bound.argmax(axis=1)
                if first:
                    q, s = np.arange(len(pdf)), best
                else:
                    kth, doc = pdf["kth"].to_numpy()[:, None], pdf["kth_doc"].to_numpy()[:, None]
                    goes = (bound > kth) | (bound == kth) & ((numbers << 40)[None, :] < doc)
                    goes[np.arange(len(pdf)), best] = False
                    q, s = np.nonzero(goes)
                out = pdf.iloc[q].reset_index(drop=True)
                yield out.assign(segment=numbers[s])[columns]

    schema = ", ".join(c for c in _ROUTE.split(", ") if "slice" not in c and "docs" not in c)
    return asking.select("query", "query_id", "q", "kth", "kth_doc").mapInPandas(run, schema)


class _Best:
    """The k best (score, document) of each query so far, best first; documents of equal scores by number."""

    def __init__(self, kth: np.ndarray, kth_doc: np.ndarray, k: int):
        self.k = k
        self.scores = np.full((len(kth), k), _NONE, np.int64)
        self.docs = np.full((len(kth), k), LONG, np.int64)
        self.kth, self.kth_doc = kth.copy(), kth_doc.copy()

    def add(self, who: np.ndarray, scores: np.ndarray, first: int, own: np.ndarray) -> None:
        """Scores (queries x documents first, first + 1, ...) of the queries `who`; `own` are their numbers as documents."""
        docs = first + np.arange(scores.shape[1])
        hit = (scores > self.kth[who, None]) | (scores == self.kth[who, None]) & (docs[None, :] < self.kth_doc[who, None])
        hit &= docs[None, :] != own[:, None]
        some = np.flatnonzero(hit.any(axis=1))
        if not len(some):
            return
        rows_, hit, n = who[some], hit[some], int(hit[some].sum(axis=1).max())
        if n < scores.shape[1]:  # only the columns that hold a hit, moved to the left
            order = np.argsort(~hit, axis=1, kind="stable")[:, :n]
            hit, found, docs = np.take_along_axis(hit, order, 1), np.take_along_axis(scores[some], order, 1), docs[order]
        else:
            found, docs = scores[some], np.broadcast_to(docs, hit.shape)
        all_scores = np.concatenate([self.scores[rows_], np.where(hit, found, _NONE)], axis=1)
        all_docs = np.concatenate([self.docs[rows_], np.where(hit, docs, LONG)], axis=1)
        best = np.lexsort((all_docs, ~all_scores), axis=1)[:, : self.k]
        self.scores[rows_], self.docs[rows_] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_docs, best, 1)
        full = self.docs[rows_, -1] != LONG
        self.kth[rows_[full]], self.kth_doc[rows_[full]] = self.scores[rows_[full], -1], self.docs[rows_[full], -1]


class Segment:
    """The blocks of a segment: first documents, forward indexes (rows of vectors) and term maxima."""

    def __init__(self, width: int):
        self.width, self.firsts, self.blocks, self.ids, self.maxima = width, [], [], [], []

    def add(self, first: int, n: int, ids: list, v: bytes, maxima: bytes) -> None:
        self.firsts.append(int(first))
        self.blocks.append((v, int(n)))
        self.ids.append(ids)
        self.maxima.append(np.frombuffer(maxima, "<i8"))

    def search(self, q: np.ndarray, own: np.ndarray, kth: np.ndarray, kth_doc: np.ndarray, k: int) -> tuple[_Best, int]:
        """The best documents above (kth, kth_doc) of each query, and how many pairs of query and document were scored.

        Each query takes its blocks in the order of their bounds, in rounds of 1, 2, 4, ... blocks, and is done with a round whose
        first bound is below its k-th score. Within a round the queries of a block are scored together, best blocks first; a
        bound is held against the k-th score as it is by then."""
        best, scored = _Best(kth, kth_doc, k), 0
        firsts = np.array(self.firsts, np.int64)
        bound = products(_terms(q), np.array(self.maxima, np.int64).reshape(len(firsts), 2 * self.width))
        order = np.argsort(-bound, axis=1, kind="stable")
        live, at, step = np.arange(len(q)), 0, 1

        def may(who: np.ndarray, blocks: np.ndarray) -> np.ndarray:
            b = bound[who, blocks]
            return (b > best.kth[who]) | (b == best.kth[who]) & (firsts[blocks] < best.kth_doc[who])

        while at < len(firsts) and len(live):
            # A bound that equals the k-th score may still bring in a smaller document, so only lower ones end a query.
            live = live[bound[live, order[live, at]] >= best.kth[live]]
            who, blocks = np.repeat(live, min(step, len(firsts) - at)), order[live, at : at + step].ravel()
            some = may(who, blocks)
            who, blocks = who[some], blocks[some]
            by_block = np.argsort(blocks, kind="stable")
            numbers, starts = np.unique(blocks[by_block], return_index=True)
            groups = dict(zip(numbers.tolist(), np.split(who[by_block], starts[1:]), strict=True)) if len(numbers) else {}
            for b in sorted(groups, key=lambda b: -int(bound[groups[b], b].max())):
                asking = groups[b][may(groups[b], np.full(len(groups[b]), b))]
                if len(asking):
                    v, n = self.blocks[b]
                    best.add(asking, products(q[asking], rows([v], self.width * n).reshape(n, self.width)), self.firsts[b], own[asking])
                    scored += len(asking) * n
            at, step = at + step, 2 * step
        return best, scored

    def ids_of(self, docs: np.ndarray) -> list:
        at = np.searchsorted(np.array(self.firsts), docs, side="right") - 1
        return [self.ids[b][int(d) - self.firsts[b]] for b, d in zip(at.tolist(), docs.tolist(), strict=True)]


_FOUND = "query bigint, query_id string, q binary, docs array<bigint>, ids array<string>, scores array<bigint>, scored bigint"


def _visited(routes: DataFrame, index: Index, k: int) -> DataFrame:
    """What each query finds in the segments that it goes to. Blocks and queries meet in the task of their segment and slice: the
    blocks come first and are held, queries stream past. Segments with many queries are several slices, with a copy each."""
    width, spark = index.width, routes.sparkSession
    counts = {r["segment"]: r["count"] for r in routes.groupBy("segment").count().collect()}  # segments are bounded
    most = max(256, math.ceil(sum(counts.values()) / partitions_of(routes)))
    slices = spark.createDataFrame([(s, max(1, math.ceil(n / most))) for s, n in counts.items()], "segment int, slices int")
    slices = F.broadcast(slices)
    # No nulls in numbers: pandas would make floats of them.
    nothing = {c: F.lit(-1 if t == "bigint" or t == "int" else None).cast(t) for c, t in (x.split() for x in (_INDEX + ", " + _ROUTE).split(", "))}
    names = ["segment", "slice", "first", "n", "ids", "v", "maxima", "query", "query_id", "q", "kth", "kth_doc"]

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(*[c if c in df.columns else nothing[c].alias(c) for c in names])

    held = index.table.where("n > 0").join(slices, "segment").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    asked = routes.join(slices, "segment").withColumn("slice", F.pmod(F.xxhash64("query"), F.col("slices")).cast("int"))
    both = shaped(held).unionByName(shaped(asked)).repartition(partitions_of(routes), "segment", "slice")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, at = Segment(width), None
        for pdf in batches:
            for place, part in pdf.groupby(["segment", "slice"], sort=True):
                if place != at:
                    segment, at = Segment(width), place
                new = part[part["n"] > 0]
                for row in zip(new["first"], new["n"], new["ids"], new["v"], new["maxima"], strict=True):
                    segment.add(*row)
                asking = part[part["n"] < 0]
                for i in range(0, len(asking), BATCH):
                    some = asking.iloc[i : i + BATCH]
                    q, own = rows(some["q"], width), some["query"].to_numpy(np.int64)
                    best, scored = segment.search(q, own, some["kth"].to_numpy(np.int64), some["kth_doc"].to_numpy(np.int64), k)
                    out = []
                    for j, (number, name, v) in enumerate(zip(own.tolist(), some["query_id"], some["q"], strict=True)):
                        n = int((best.docs[j] != LONG).sum())
                        docs = best.docs[j, :n]
                        out.append((number, name, v, docs, segment.ids_of(docs), best.scores[j, :n], scored if not j else 0))
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")])

    return both.sortWithinPartitions("segment", "slice", F.desc("n")).mapInPandas(run, _FOUND)


def top_k(vectors: DataFrame, asks: Column, k: int = TOP, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, scored: list[DataFrame] | None = None) -> DataFrame:
    """(query_id, rank, <id>, score): for every row with `asks` the k other rows of highest inner product of floor(scale * x), all
    if fewer; ranks are from 1, equal scores by id, null ids last.

    A vector that is null or holds a null or non-finite component takes no part; shorter vectors go with zeros at their end.
    Only a query's own row is left out: rows that repeat it, with the same id or not, are candidates, and repeated queries
    get a list each. Scores are exact and cut to the range of a long, which goes for components too. An empty table gives
    no rows. Other columns are ignored. `scored` gets the tables whose column of that name counts the scored pairs."""
    if k < 1:
        raise ValueError("k must be at least 1")
    index = build(vectors, asks, id, vector, scale)
    asking = queries(index).withColumns({"kth": F.lit(_NONE), "kth_doc": F.lit(LONG)})
    near = materialize(_visited(_routed(asking, index, True), index, k))
    full = F.size("docs") >= k
    known = near.withColumns({"kth": F.when(full, F.element_at("scores", k)).otherwise(F.lit(_NONE)), "kth_doc": F.when(full, F.element_at("docs", k)).otherwise(F.lit(LONG))})
    far = materialize(_visited(materialize(_routed(known, index, False)), index, k))
    if scored is not None:
        scored += [near, far]
    lists = near.unionByName(far).select("query", "query_id", F.explode(F.arrays_zip("docs", "ids", "scores")).alias("x"))
    best = Window.partitionBy("query").orderBy(F.desc("x.scores"), "x.docs")
    ranked = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    kind = vectors.schema[id].dataType
    return ranked.select(F.col("query_id").cast(kind).alias("query_id"), "rank", F.col("x.ids").cast(kind).alias(id), F.col("x.scores").alias("score"))
