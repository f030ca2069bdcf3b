"""Lempel-Ziv phrase fingerprints: the phrases that LZ78 parses a text into, as a minimum-hash signature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lexivec.llm.common import partitions_of, text_of
from lexivec.llm.hashing import RangeHasher
from lexivec.operators.evaluate import slice_of

#: The smallest phrase hashes that a signature keeps.
SIZE = 128
#: About so many ids, chosen by their hashes, tell where ranges of ids begin; this only affects how even the ranges are.
SAMPLED_IDS = 50_000


class PhraseHasher:
    """Parses bytes into dictionary phrases and hashes each phrase to 32 bits."""

    def __init__(self) -> None:
        self.hasher = RangeHasher(20240503)
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def parse(data: bytes, phrases: dict[int, int], at: int, to: int, node: int = 0) -> tuple[list[int], int]:
        """Ends of the phrases that close in data[at:to], and the node of an open phrase; phrases maps (node, byte) to a node."""
        ends: list[int] = []
        get, end = phrases.get, ends.append
        size = len(phrases)
        for i, c in enumerate(data[at:to], at + 1):
            key = node | c
            node = get(key)
            if node is None:
                size += 1
                phrases[key] = size << 8
                end(i)
                node = 0
        return ends, node

    def hashes(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash for each data[start:end]."""
        return (self.hasher(np.frombuffer(data, np.uint8), starts, ends) >> np.uint64(32)).astype(np.uint32)

    def phrase_hashes(self, data: bytes, ends: list[int]) -> np.ndarray:
        """Hashes of the phrases with these ends; what is left after the last one is a phrase too."""
        if not data:
            return np.zeros(0, np.uint32)
        e = np.array(ends if ends and ends[-1] == len(data) else [*ends, len(data)])
        return self.hashes(data, np.r_[0, e[:-1]], e)

    def both(self, data: bytes, edited: bytes, common: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrase hashes of data and of edited, which agree in their first `common` bytes: these are parsed once."""
        phrases: dict[int, int] = {}
        ends, node = self.parse(data, phrases, 0, common)
        more, _ = self.parse(edited, dict(phrases), common, len(edited), node)
        rest, _ = self.parse(data, phrases, common, len(data), node)
        return self.phrase_hashes(data, ends + rest), self.phrase_hashes(edited, ends + more)

    def one(self, data: bytes) -> np.ndarray:
        return self.phrase_hashes(data, self.parse(data, {}, 0, len(data))[0])


def signature(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The `size` smallest distinct hashes, sorted."""
    return np.unique(hashes)[:size]


def show(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """The share of the smallest hashes of the union that both have, which estimates the phrase sets' Jaccard similarity;
    two texts without phrases are alike."""
    union = np.union1d(a, b)[:size]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean()) if len(union) else 1.0


def fingerprint(docs: DataFrame, into: str = "fingerprint", size: int = SIZE) -> DataFrame:
    """docs (text, ...) with the signature of each text as hexadecimal digits, eight for each hash.

    A null text is an empty one, with an empty fingerprint."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = PhraseHasher()
        for batch in batches:
            yield pd.Series([show(signature(hasher.one(t.encode("utf-8", "surrogatepass")), size)) for t in batch], dtype=object)

    return docs.withColumn(into, of(text_of()))


def compare(a: str | Column, b: str | Column, size: int = SIZE) -> Column:
    """likeness() of two columns of fingerprints."""

    @F.pandas_udf("double")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        def read(x: str) -> np.ndarray:
            return np.frombuffer(bytes.fromhex(x or ""), ">u4")

        return pd.Series([likeness(read(x), read(y), size) for x, y in zip(left, right, strict=True)])

    return of(a, b)


def _bounds(rows: DataFrame, n: int) -> list:
    """Up to n - 1 ids, in order, that cut the range of doc_id into even parts; ids can be of any type that has an order."""
    share = max(1, rows.count() // SAMPLED_IDS)
    ids = rows.select("doc_id").where("doc_id is not null").distinct().where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    found = [r[0] for r in ids.orderBy("doc_id").collect()]
    return [found[k * len(found) // n] for k in range(1, n)] if len(found) > n else found[1:]


def edited_pairs(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """For each row of docs (doc_id, text): n_chars, the edited text's SHA-256, both fingerprints, and the likeness of
    the text's fingerprint to those of its edited text and of the next document.

    The next document is that with the next smaller doc_id, null ids coming last, and the first one after the last one;
    of equal ids the smaller text comes first. The edited text has the last half of the text's code points replaced by
    as many from the start of the next. Rows are dealt by ranges of doc_id; each range also gets the first row of the
    range after it, so no other rows meet. A null text is an empty one; a single row is its own next."""
    import hashlib

    rows = docs.select("doc_id", text_of().alias("text"))
    bounds = _bounds(rows, partitions_of(docs))
    part = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(len(bounds) - slice_of(F.col("doc_id"), bounds))
    rows = rows.withColumn("part", part.cast("int")).withColumn("tail", F.lit(False))
    first = sorted((r["part"], r["first"]) for r in rows.groupBy("part").agg(F.max("doc_id").alias("first")).collect())
    # The first id of each part goes to the part before it, around the end; of rows with that id only the smallest text.
    heads = [(p, i, first[k - 1][0]) for k, (p, i) in enumerate(first)]
    heads = docs.sparkSession.createDataFrame(heads, StructType([StructField("at", IntegerType()), StructField("first", docs.schema["doc_id"].dataType), StructField("before", IntegerType())]))
    tails = rows.join(F.broadcast(heads), (F.col("part") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("before", "doc_id").agg(F.min("text").alias("text"))
    tails = tails.select("doc_id", "text", F.col("before").alias("part"), F.lit(True).alias("tail"))
    dealt = (
        rows.unionByName(tails)
        .repartitionById(len(bounds) + 2, "part")
        .sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), "text")
        .select(F.col("doc_id").cast("string").alias("doc_id"), "text", "part", "tail")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = PhraseHasher()
        held = None  # (doc_id, text, part) of the row before
        waiting = None  # a row that lacks only its likeness to the next text's signature

        def done(last: tuple, sig: np.ndarray) -> tuple:
            *row, own = last
            return (*row, likeness(own, sig, size))

        for pdf in batches:
            out = []
            for doc_id, text, p, tail in pdf.itertuples(index=False, name=None):
                if held is not None and held[2] == p:
                    own, n = held[1], len(held[1])
                    stay = n - n // 2
                    edited = own[:stay] + text[: n // 2]
                    data, changed = own.encode("utf-8", "surrogatepass"), edited.encode("utf-8", "surrogatepass")
                    a, b = hasher.both(data, changed, len(own[:stay].encode("utf-8", "surrogatepass")))
                    sa, sb = signature(a, size), signature(b, size)
                    if waiting:
                        out.append(done(waiting, sa))
                    waiting = (held[0], n, hashlib.sha256(changed).hexdigest(), show(sa), show(sb), likeness(sa, sb, size), sa)
                if tail:
                    if waiting:
                        out.append(done(waiting, signature(hasher.one(text.encode("utf-8", "surrogatepass")), size)))
                    held = waiting = None
                else:
                    held = (doc_id, text, p)
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "doc_id string, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
