"""Which texts hold which passages, for many passages at once: the rarest run of characters of each passage finds candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.sources.folders import materialize

#: Characters of a run; a shorter passage is one run.
RUN = 12
#: Bits of the filter for each run, and the most in all (32 MB): every task gets it. With more runs than fit it lets more pass.
KEY_BITS, MOST_BITS = 16, 1 << 28
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
#: The hash of an empty passage, which every text has.
EMPTY_HASH = [0]


def run_hashes(text: str, length: int) -> np.ndarray:
    """A hash of each run of `length` code points of a text, in order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.full(n, length, np.uint64)
    for i in range(length):
        out = out * np.uint64(_BASE) + codes[i : i + n]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(_MIX)
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def _filter(hashes: DataFrame, count: int) -> Broadcast:
    """(bits, size) of the hashes in the first column, as a bitmap of bytes; at most MOST_BITS."""
    size = min(MOST_BITS, max(1 << 15, 1 << (KEY_BITS * count).bit_length()))
    place = F.pmod(F.col(hashes.columns[0]), F.lit(size)) + 1  # buckets and positions are counted from 1 on
    parts = hashes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for r in parts.collect():
        bits[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast((bits, size))


def _passing(text: str, lengths: list[int], bits: np.ndarray, size: int) -> np.ndarray:
    """The hashes of a text's runs that the filter lets pass."""
    found = []
    for length in lengths:
        h = run_hashes(text, length) if length else np.array(EMPTY_HASH)
        place = h & (size - 1)
        found.append(h[(bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _runs_of(passages: DataFrame) -> DataFrame:
    """(qid, hash, length): the distinct runs of each passage (qid, question); an empty passage has one of length 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for qid, question in zip(pdf["qid"], pdf["question"], strict=True):
                length = min(RUN, len(question))
                h = np.unique(run_hashes(question, length)) if length else np.array(EMPTY_HASH)
                yield pd.DataFrame({"qid": [qid] * len(h), "hash": h, "length": length})

    kind = passages.schema["qid"].dataType.simpleString()
    return passages.mapInPandas(run, f"qid {kind}, hash bigint, length int")


def containing(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, key) of the chunks (key, text) whose text holds the whole text of the question (qid, question).

    A text that holds a passage has each of its runs. The runs of all passages are counted in the texts, and each passage is
    looked up by the run that is rarest there, whatever its length; a passage with a run that no text has is in none. Texts
    of candidates are then compared. Null passages and texts match nothing; an empty passage is in every text that is not null.
    Passages go to tasks only as a filter of bounded size, so there may be any number of them."""
    asked = materialize(questions.where("qid is not null and question is not null").select("qid", "question"))
    runs = materialize(_runs_of(asked))
    lengths = sorted(r["length"] for r in runs.select("length").distinct().collect())
    texts = chunks.where("text is not null").select("key", "text")
    kind = chunks.schema["key"].dataType.simpleString()
    every = _filter(runs.select("hash"), runs.count())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, size = every.value
        for pdf in batches:
            found = [_passing(t, lengths, bits, size) for t in pdf["text"]]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
            yield pd.DataFrame({"hash": h, "n": n})

    counts = texts.select("text").mapInPandas(count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    known = runs.join(counts, "hash", "left").groupBy("qid").agg(F.min_by("hash", F.struct(F.coalesce("n", F.lit(0)), "hash")).alias("hash"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    chosen = materialize(known.where("n > 0").select("hash", "qid"))
    picked = _filter(chosen.select("hash"), chosen.count())

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, size = picked.value
        for pdf in batches:
            found = [np.unique(_passing(t, lengths, bits, size)) for t in pdf["text"]]
            keys = [k for k, h in zip(pdf["key"], found, strict=True) for _ in range(len(h))]
            yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "hash": np.concatenate(found) if found else np.zeros(0, np.int64)})

    maybe = texts.mapInPandas(look, f"key {kind}, hash bigint").join(chosen, "hash").select("qid", "key")
    return maybe.join(asked, "qid").join(texts, "key").where(F.contains("text", "question")).select("qid", "key")
