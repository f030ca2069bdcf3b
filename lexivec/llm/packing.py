"""Packing tokenized documents into sequences of a fixed capacity by the sum-of-squares rule."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import partitions_of, text_of
from lexivec.sources.folders import materialize

CAPACITY = 4096
END_ID = 1
#: Items that one task packs; leftovers of the tasks are packed again together.
GROUP_ITEMS = 50_000
#: Bytes of words and ids that a worker's cache holds before it starts anew, and the longest word that it keeps. A word is counted
#: with ENTRY_BYTES for the entry itself.
CACHE_BYTES, CACHED_WORD, ENTRY_BYTES = 300 << 20, 64, 150


def byte_chars() -> list[str]:
    """The character that byte-level tokenizers use for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordEncoder(dict):
    """Token ids, as little-endian unsigned 32-bit numbers, of texts under a tokenizer that lower-cases and drops white space.

    For these tokenizers the ids of a text are those of its words in turn, so each worker keeps them by word. Words of
    plain Latin letters, with a punctuation mark at most, go to the merge model directly; all else to the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.held = 0
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        if self.model.end_of_word_suffix != "</w>" or type(self.tokenizer.normalizer).__name__ != "Sequence":
            raise ValueError("WordEncoder needs a tokenizer with word ends that drops white space")
        self.chars = byte_chars()

    def __missing__(self, word: str) -> bytes:
        return self._kept(word, np.array(self._ids(word), "<u4").tobytes())

    def _kept(self, word: str, value: bytes | int) -> bytes | int:
        """value, after keeping it for a word that is not too long. The cache starts anew when it is full."""
        if len(word) <= CACHED_WORD:
            if self.held > CACHE_BYTES:
                self.clear()
                self.held = 0
            self[word] = value
            self.held += ENTRY_BYTES + (len(word) if word.isascii() else 4 * len(word)) + (len(value) if isinstance(value, bytes) else 0)
        return value

    def _ids(self, word: str) -> list[int]:
        if word and max(word) < "ɐ" and "İ" not in word:
            low = word.lower()
            parts = [low] if low.isalpha() else [low[:-1], low[-1]] if low[:-1].isalpha() and low[-1] in ".,;:!?" else None
            if parts:
                return [t.id for p in parts for t in self.model.tokenize(p if p.isascii() else "".join([self.chars[b] for b in p.encode()]))]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        for c in "\n\t\r":
            if c in text:
                text = text.replace(c, " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


class WordCounter(WordEncoder):
    """Numbers of token ids, kept by word as WordEncoder keeps the ids."""

    def __missing__(self, word: str) -> int:
        return self._kept(word, len(self._ids(word)))

    def count(self, text: str) -> int:
        for c in "\n\t\r":
            if c in text:
                text = text.replace(c, " ")
        return sum(map(self.__getitem__, text.split(" ")))


def token_count(tokenizer: str, text: str = "text") -> Column:
    """The number of ids of a text by a tokenizer file, without special ones; a null text has none."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = WordCounter(tokenizer)
        for batch in batches:
            yield pd.Series([counter.count(t) for t in batch], dtype="int64")

    return count(text_of(text))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and END_ID, cut only where longer than capacity."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for pdf in batches:
            out: list[tuple] = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                data = encoder.encode(text) + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else [])))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    schema = "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text")).mapInPandas(cut, schema).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, largest first: an item goes where the sum over levels of the squared number of open
    bins grows least, of equal choices into the fullest bin. Full bins are closed and don't count."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        levels = np.flatnonzero(count[: capacity - size + 1])
        level = 0
        if len(levels):
            to = count[levels + size]
            growth = np.where(levels + size == capacity, 1 - 2 * count[levels], 2 * (to - count[levels]) + 2)
            least = growth.min()
            if least <= (2 * count[size] + 1 if size < capacity else 0):
                level = int(levels[growth == least][-1])
        if level:
            b = open_at[level].pop()
            count[level] -= 1
        else:
            b, n = n, n + 1
        bins[i], offsets[i] = b, level
        if level + size < capacity:
            open_at[level + size].append(b)
            count[level + size] += 1
    return bins, offsets


def _packed_once(items: DataFrame, capacity: int, number: int) -> tuple[DataFrame, int]:
    """(item, bin, offset, size) of items (item, size), packed in groups of about GROUP_ITEMS; the number of groups."""
    groups = max(1, math.ceil(items.count() / GROUP_ITEMS))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", ignore_index=True)
        bins, offsets = sum_of_squares(pdf["size"].to_numpy(), capacity)
        base = (number << 56) | (int(pdf["g"].iloc[0]) << 28)
        return pd.DataFrame({"item": pdf["item"], "bin": bins + base, "offset": offsets, "size": pdf["size"]})

    dealt = items.withColumn("g", F.pmod(F.xxhash64("item", F.lit(number)), F.lit(groups)))
    return materialize(dealt.groupBy("g").applyInPandas(pack, "item bigint, bin bigint, offset bigint, size bigint")), groups


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of docs (doc_id, text) with sequence_id and offset: each sequence is filled from 0 without gaps.

    Pieces of the full capacity are sequences of their own. The others are packed in groups; the bins that a round leaves
    open are items of the next one, until one group holds them all or a round puts none of them together.
    A null or empty text is END_ID alone; null ids are ids like any others; repeated rows are packed each by itself."""
    cut = materialize(pieces(docs, tokenizer, capacity, with_ids).withColumn("item", F.monotonically_increasing_id()))
    items = cut.where(F.col("length") < capacity).select("item", F.col("length").alias("size"))
    placed = now = None
    number, before = 0, None
    while True:
        now, groups = _packed_once(items, capacity, number)
        if placed is None:
            placed = now
        else:
            moves = now.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("by"))
            placed = materialize(placed.join(moves, "bin", "left").select("item", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"), "size"))
        bins = materialize(now.groupBy("bin").agg(F.sum("size").alias("size")))
        n = bins.count()
        if groups == 1 or n == before:
            break
        items = bins.where(F.col("size") < capacity).select(F.col("bin").alias("item"), "size")
        number, before = number + 1, items.count()
    whole = F.col("length") >= capacity
    return cut.join(placed.select("item", "bin", "offset"), "item", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids,
        F.when(whole, -1 - F.col("item")).otherwise(F.col("bin")).alias("sequence_id"), F.when(whole, 0).otherwise(F.col("offset")).cast("bigint").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_starts) from pack(with_ids=True): one row of at most the capacity for each sequence.

    Pieces are put in the order of their offsets; an empty table has no sequence. Rows that repeat a piece of pack() in
    its place make the sequence longer than it is: pass what pack() gave."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    out = packed.repartition(partitions_of(packed), "sequence_id").groupBy("sequence_id").agg(parts.alias("p"))
    return out.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["offset"]).alias("doc_starts"))
