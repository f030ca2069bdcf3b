"""Sparse and dense index tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.config import DEFAULT, Config
from lexivec.functions import scores as S
from lexivec.functions import text as T
from lexivec.operators.meet import small_batches
from lexivec.sources.folders import remove


def chunk_tokens(chunks: DataFrame, key: str) -> DataFrame:
    """(key, tokens) of chunks (key, text)."""
    return chunks.select(key, T.tokens(F.col("text")).alias("tokens"))


def postings(tokened: DataFrame, key: str) -> DataFrame:
    """(term, key, tf); counts are summed before the shuffle."""
    return tokened.select(key, F.explode("tokens").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def corpus_stats(tokened: DataFrame) -> DataFrame:
    """One row: n chunks and their mean length."""
    return tokened.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("avgdl"))


def document_frequency(tokened: DataFrame) -> DataFrame:
    """(term, df)."""
    return tokened.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(df: DataFrame, n: int, config: Config = DEFAULT) -> DataFrame:
    """df (term, df, ...) with idf, for n chunks: a term that more than half of the chunks have gets a part of the mean."""
    raw = df.withColumn("raw", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = (raw.agg(F.avg("raw")).first()[0] or 0.0) * config.bm25_epsilon
    return raw.select(*df.columns, F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))


#: Parts of scores are whole numbers of this size, so that their sums do not depend on the order of rows; a score can be up
#: to 92,233.
UNIT = 1e-14
#: Chunks of a segment, and of a block within it: powers of two, as numbers of chunks are cut at bits.
SEGMENT, BLOCK = 1 << 16, 1 << 4


@dataclass(frozen=True)
class SparseIndex:
    """Tables of a BM25 index, and its two numbers.

    terms: (term, df, idf, most), most being the largest part, in units, that the term adds to any score.
    postings: (segment, term, df, most, docs, weights, blocks, maxima), a row for each term of a segment of chunks: the chunks' places
    in the segment, in the order of their keys, with what the term adds to each score before it is multiplied by idf; and the blocks
    of chunks that have the term, with the largest weight in each. `df` is the number of docs, `most` the largest weight of all.
    keys: (segment, doc, key), all chunks."""

    terms: DataFrame
    postings: DataFrame
    keys: DataFrame
    n: int
    avgdl: float


#: Chunks whose terms a task counts at once.
PART = 1 << 10
#: A segment is closed once it has so many postings, which bounds what a task holds while it gathers one.
POSTINGS = 4 << 20
#: Terms, and about as many postings, of a batch that a task passes on.
FRAME, FRAME_POSTINGS = 20_000, 1 << 18


def _lists(offsets: np.ndarray, values: pa.Array | np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values) if isinstance(values, np.ndarray) else values)


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


class _Run:
    """The chunks of one segment while they come in: of each part the keys and lengths, its terms, and its postings as numbers."""

    def __init__(self):
        self.n = self.n_terms = self.n_postings = 0
        self.keys, self.lengths, self.terms, self.postings = [], [], [], []

    def add(self, keys: pa.Array, lengths: pa.Array, words: pa.Array) -> None:
        """Chunks with their tokens, as strings with a space between two."""
        sizes = lengths.fill_null(0)
        # Only chunks with tokens are split, as an empty string gives one word; and a copy, as pyarrow splits a part of an array wrongly if that has nulls.
        coded = pc.split_pattern(words.filter(pc.greater(sizes, 0)), " ").flatten().dictionary_encode()
        docs = np.repeat(np.arange(len(keys)), _numbers(sizes))
        pairs = np.sort(_numbers(coded.indices).astype(np.int64) * len(keys) + docs)
        starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
        terms, docs = np.divmod(pairs[starts], len(keys))
        tfs = np.diff(np.append(starts, len(pairs)))
        self.postings.append(((terms + self.n_terms).astype(np.int32), (docs + self.n).astype(np.int32), tfs.astype(np.int32)))
        self.keys.append(keys)
        self.lengths.append(lengths)
        self.terms.append(coded.dictionary)
        self.n, self.n_terms, self.n_postings = self.n + len(keys), self.n_terms + len(coded.dictionary), self.n_postings + len(starts)

    def rows(self, segment: int) -> Iterator[pa.RecordBatch]:
        """Rows (segment, chunks, postings): first the chunks in the order of their keys, then the postings by term."""
        keys, lengths = pa.concat_arrays(self.keys), pa.concat_arrays(self.lengths)
        by_key = _numbers(pc.array_sort_indices(keys))
        by_key = np.r_[by_key[len(keys) - keys.null_count :], by_key[: len(keys) - keys.null_count]]
        place = np.empty(self.n, np.int32)
        place[by_key] = np.arange(self.n, dtype=np.int32)
        keys, lengths = keys.take(pa.array(by_key)), lengths.take(pa.array(by_key))
        chunks = pa.StructArray.from_arrays([pa.array(np.arange(self.n, dtype=np.int32)), keys, lengths], ["doc", "key", "dl"])
        cuts = np.append(np.arange(0, self.n, PART), self.n)
        names = ["segment", "chunks", "postings"]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts) - 1, segment)), _lists(cuts, chunks), pa.nulls(len(cuts) - 1, pa.binary())], names)
        every = pa.concat_arrays(self.terms).dictionary_encode()
        by_term = _numbers(pc.array_sort_indices(every.dictionary))
        rank = np.empty(len(by_term), np.int64)
        rank[by_term] = np.arange(len(by_term))
        rank, vocabulary = rank[_numbers(every.indices)], every.dictionary.take(pa.array(by_term))
        terms, docs, tfs = (np.concatenate(x) for x in zip(*self.postings, strict=True))
        self.postings, terms, docs = [], rank[terms], place[docs]
        offsets = np.append(0, np.cumsum(np.bincount(terms, minlength=len(vocabulary))))
        terms *= self.n
        terms += docs
        order = np.argsort(terms)
        del terms, rank, every
        docs, tfs, dl, at = docs[order], tfs[order], _numbers(lengths.fill_null(0)), 0
        while at < len(vocabulary):
            end = min(at + FRAME, max(at + 1, int(np.searchsorted(offsets, offsets[at] + FRAME_POSTINGS, side="right")) - 1))
            some, own = slice(offsets[at], offsets[end]), offsets[at : end + 1] - offsets[at]
            frame = pa.RecordBatch.from_arrays([vocabulary.slice(at, end - at), *[_lists(own, x) for x in (docs[some], tfs[some], dl[docs[some]])]], ["term", "docs", "tfs", "lengths"])
            yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.nulls(1, pa.list_(chunks.type)), pa.array([_packed(frame)], pa.binary())], names)
            at = end


def _packed(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _counted(batches: Iterator[pa.RecordBatch], segment: int, postings: int) -> Iterator[pa.RecordBatch]:
    """Rows (segment, chunks, postings) of chunks (key, dl, words): of each segment its chunks, and then its postings as packed
    batches (term, docs, tfs, lengths). A segment lies in one task, so that its postings meet without a shuffle."""
    at, run = TaskContext.get().partitionId() << 32, _Run()
    for batch in batches:
        i = 0
        while i < len(batch):
            n = min(PART, segment - run.n)
            run.add(*batch.slice(i, n).columns)
            i += n
            if run.n >= segment or run.n_postings >= postings:
                yield from run.rows(at)
                at, run = at + 1, _Run()
    if run.n:
        yield from run.rows(at)
    del run
    pa.default_memory_pool().release_unused()


_POSTINGS = "segment bigint, term string, df int, most double, docs array<int>, weights array<double>, blocks array<int>, maxima array<double>"


def _weighted(batches: Iterator[pa.RecordBatch], avgdl: float, config: Config) -> Iterator[pa.RecordBatch]:
    """Rows of _POSTINGS of the packed ones."""
    k1, b = config.bm25_k1, config.bm25_b
    columns = [c.split()[0] for c in _POSTINGS.split(", ")]
    for batch in batches:
        for segment, packed in zip(*batch.columns, strict=True):
            for frame in pa.ipc.open_stream(packed.as_buffer()):
                docs = frame.column("docs")
                offsets, d = _numbers(docs.offsets), _numbers(docs.values)
                tf, dl = (_numbers(frame.column(c).values).astype(float) for c in ("tfs", "lengths"))
                weights = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
                of = d >> (BLOCK.bit_length() - 1)
                fresh = np.r_[True, of[1:] != of[:-1]]
                fresh[offsets[:-1]] = True
                starts = np.flatnonzero(fresh)
                blocks = np.searchsorted(starts, offsets)
                facts = [np.full(len(frame), segment.as_py()), frame.column("term"), np.diff(offsets), np.maximum.reduceat(weights, offsets[:-1])]
                lists = [_lists(offsets, d), _lists(offsets, weights), _lists(blocks, of[starts]), _lists(blocks, np.maximum.reduceat(weights, starts))]
                yield pa.RecordBatch.from_arrays([*[pa.array(x) if isinstance(x, np.ndarray) else x for x in facts], *lists], columns)


def build_index(chunks: DataFrame, folder: str, config: Config = DEFAULT) -> SparseIndex:
    """Writes the index of chunks (key, text), or (key, tokens), whose keys are unique, into a folder, in place of what is there,
    and loads it. Tokens, if given, have no space in them.

    Texts are tokenised once, where they lie, and nothing is shuffled but the counts of terms: a segment is a run of at most
    SEGMENT chunks of one partition, which ends early at POSTINGS postings; its task numbers the chunks in the order of their keys and
    gathers their postings by term. So no row and no task has all postings of a frequent term. Rows are sorted by segment and term in
    their files. Weights need the mean length of all chunks, so counts are written first."""
    spark = chunks.sparkSession
    tokened = chunks.select("key", "tokens") if "tokens" in chunks.columns else chunk_tokens(chunks, "key")
    words = tokened.select("key", F.size("tokens").alias("dl"), F.array_join("tokens", " ").alias("words"))
    segment, most = SEGMENT, POSTINGS
    schema = f"segment bigint, chunks array<struct<doc int, key {chunks.schema['key'].dataType.simpleString()}, dl int>>, postings binary"
    with small_batches(spark):
        words.mapInArrow(lambda batches: _counted(batches, segment, most), schema).write.mode("overwrite").parquet(f"{folder}/counts")
    counts = spark.read.schema(schema).parquet(f"{folder}/counts")
    counts.select("segment", F.inline("chunks")).write.mode("overwrite").parquet(f"{folder}/keys")
    facts = spark.read.parquet(f"{folder}/keys").agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    facts.write.mode("overwrite").parquet(f"{folder}/facts")
    n, avgdl = spark.read.parquet(f"{folder}/facts").first()
    packed = counts.where("postings is not null").select("segment", "postings")
    with small_batches(spark):
        packed.mapInArrow(lambda batches: _weighted(batches, avgdl or 1.0, config), _POSTINGS).write.mode("overwrite").parquet(f"{folder}/postings")
    remove(spark, f"{folder}/counts")
    stats = spark.read.parquet(f"{folder}/postings").groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"))
    stats.write.mode("overwrite").parquet(f"{folder}/df")
    weights = idf(spark.read.parquet(f"{folder}/df"), n, config)
    weights.select("term", "df", "idf", F.round(F.col("idf") * F.col("most") / UNIT).cast("bigint").alias("most")).write.mode("overwrite").parquet(f"{folder}/terms")
    return load_index(spark, folder)


def load_index(spark: SparkSession, folder: str) -> SparseIndex:
    """The index that build_index wrote; a folder without one, or with one that was not finished, is an error."""
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in ("terms", "postings", "keys", "facts")}
    facts = tables["facts"].first()
    return SparseIndex(tables["terms"], tables["postings"], tables["keys"].select("segment", "doc", "key"), facts["n"], facts["avgdl"])


def dense_index(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, embedding) with unit vectors."""
    return vectors.select(key, S.normalized(F.col(vector)).alias("embedding"))


def alignment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row that compares the ids of two indexes: matched, only_left, only_right, and rows beyond the first of an id."""
    a = left.groupBy(key).agg(F.count("*").alias("a"))
    b = right.groupBy(key).agg(F.count("*").alias("b"))
    both = a.join(b, key, "full_outer")
    return both.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"),
        F.coalesce(F.sum(F.coalesce(F.col("a") - 1, F.lit(0)) + F.coalesce(F.col("b") - 1, F.lit(0))), F.lit(0)).cast("bigint").alias("duplicates"),
    )


def index_meta(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, vector: str, config: Config = DEFAULT) -> DataFrame:
    """One row of build facts."""
    none = F.lit(None).cast("bigint")
    facts = docs.agg(F.count("*").alias("doc_count")).select("doc_count", none.alias("chunk_count"), none.alias("dim"))
    facts = facts.unionByName(chunks.agg(F.count("*").alias("chunk_count")), allowMissingColumns=True)
    facts = facts.unionByName(vectors.agg(F.max(F.size(vector)).cast("bigint").alias("dim")), allowMissingColumns=True)
    return facts.agg(*[F.max(c).alias(c) for c in ("doc_count", "chunk_count", "dim")]).withColumn("chunk_strategy", F.lit(config.chunk_strategy))
