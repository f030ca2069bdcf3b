"""Which tokens of two tokenizers stand for the same bytes, and how many documents link each pair of ids.

Pairs of ids are counted in dense matrices, each of a stripe of the first tokenizer's ids, so that the counts of one id, and
with them its highest, lie in one task. Links go to the stripe that counts them, and only sums by document come back."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import partitions_of, text_of
from lexivec.llm.packing import byte_chars
from lexivec.sources.folders import materialize

#: Stripes at least; documents (12 bits) and pairs after which a task writes what it has gathered; characters of the texts
#: that it aligns at once; pairs of a slice of a stripe at least.
STRIPES, CHUNK_DOCS, CHUNK_PAIRS, BATCH_CHARS, SLICE_PAIRS = 64, 4096, 1 << 20, 1 << 20, 1 << 22
#: Bytes that a worker's cache of words holds before it starts anew, and the characters of the longest word in it.
CACHE_BYTES, CACHED_WORD = 96 << 20, 64
#: Links of a group up to which they are written out one by one.
GROUP_LINKS = 4096
#: Cells of a matrix in one row of the table of counts at most.
CELLS = 1 << 18

_CUT = re.compile(r"(?<=\S)(?= )")
_LOOSE = re.compile(r"\s ")


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each span, one span after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class ByteLevel:
    """Ids and their bytes of a byte-level tokenizer's file, whose special strings are text like any other.

    Where ids follow the order of the merges, words of Latin characters go to an implementation that needs no offsets; that
    and the whole tokenizer give the same ids (a test compares them)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        to_byte = {c: bytes([i]) for i, c in enumerate(byte_chars())}
        self.bytes = [b""] * self.whole.get_vocab_size()
        for token, i in self.whole.get_vocab().items():
            self.bytes[i] = b"".join([to_byte.get(c, c.encode()) for c in token])
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.fast = None
        if all(model["vocab"][m] == 256 + i for i, m in enumerate(merges)):
            import public_tokenizers
            import tiktoken

            self.fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks={self.bytes[i]: i for i in model["vocab"].values()}, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast and len(text) <= CACHED_WORD and max(text) < "ɐ":
            return self.fast.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids


class Pair:
    """Two tokenizers, a byte-level file and a piece model, with a table of words: a word is a space and what follows up to the
    next space after other text.

    Neither tokenizer joins what is left and right of such a place: the first cuts texts there, and the second has no piece with
    a space after another character. So the tokens of a text are those of its words, and groups end where words end.
    The table has for each word its groups as text, the numbers of tokens, groups and links, and its distinct pairs of ids with their
    links. A pair's code is its stripe, its row there and its second id."""

    def __init__(self, first: str, second: str, stripes: int = 1):
        from sentencepiece import SentencePieceProcessor

        self.first, self.second, self.stripes = ByteLevel(first), SentencePieceProcessor(model_file=second), stripes
        self.width = self.second.get_piece_size()
        self.height = math.ceil(len(self.first.bytes) / stripes)
        pieces = [self.second.id_to_piece(i) for i in range(self.width)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("the second tokenizer has pieces with a space inside")
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.second.piece_to_id("▁")
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.first.bytes, self.b_bytes))
        # The text of an id where another one of its side follows, where its side of a group ends, and where its word ends.
        self.a_text = np.array([[f"{i}{c}" for i in range(len(self.a_size))] for c in ",|"], object)
        self.b_text = np.array([[f"{i}{c}" for i in range(self.width)] for c in ",;\n"], object)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.texts: list[str] = []
        self.sums, self.first_code, self.whole = np.zeros((0, 4), np.int64), np.zeros(1, np.int64), np.zeros(0, bool)
        self.codes, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held = 0

    def words(self, text: str) -> list[str]:
        """The words of a space and the text, each without its first space; none if the text can't have tokens."""
        if not text or "▁" in text:
            return []
        if text[0] == " " or _LOOSE.search(text):
            return [w[1:] for w in _CUT.split(" " + text)]
        return text.split(" ")

    def _tabled(self, new: list[str]) -> tuple:
        """The rows of the table for words that it does not have."""
        a_ids = [self.first.encode(" " + w) for w in new]
        b_ids = self.second.encode(new, num_threads=1)
        for i, w in enumerate(new):
            data = f" {w}".encode()
            if not w:
                b_ids[i] = [self.space]
            if b"".join([self.b_bytes[j] for j in b_ids[i]]) != data or sum([len(self.first.bytes[j]) for j in a_ids[i]]) != len(data):
                a_ids[i] = b_ids[i] = []
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(new)) for x in (a_ids, b_ids))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a_ids, n_a), (b_ids, n_b)))
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        of_a, of_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        in_a, in_b = np.bincount(of_a, minlength=len(ends)), np.bincount(of_b, minlength=len(ends))
        word_a, word_b = (np.repeat(np.arange(len(new)), n) for n in (n_a, n_b))
        last_a, last_b = np.cumsum(in_a) - 1, np.cumsum(in_b) - 1  # of each group
        word = word_a[last_a]
        n_links = in_a * in_b
        # Links: each first id with all second ids of its group; of groups with many, the distinct ids and their counts.
        few = np.flatnonzero(n_links[of_a] <= GROUP_LINKS)
        many = in_b[of_a[few]]
        x, y = np.repeat(a[few], many), b[spans(last_b[of_a[few]] - many + 1, many)]
        at, times = np.repeat(word_a[few], many), np.ones(len(x), np.int64)
        for g in np.flatnonzero(n_links > GROUP_LINKS).tolist():
            p, m = np.unique(a[last_a[g] - in_a[g] + 1 : last_a[g] + 1], return_counts=True)
            q, o = np.unique(b[last_b[g] - in_b[g] + 1 : last_b[g] + 1], return_counts=True)
            x, y = np.r_[x, np.repeat(p, len(q))], np.r_[y, np.tile(q, len(p))]
            at, times = np.r_[at, np.full(len(p) * len(q), word[g])], np.r_[times, np.outer(m, o).ravel()]
        code = (x % self.stripes * self.height + x // self.stripes) * self.width + y
        order = np.lexsort((code, at))
        code, at = code[order], at[order]
        begins = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (at[1:] != at[:-1])]) if len(code) else np.zeros(0, np.int64)
        links = np.add.reduceat(times[order], begins) if len(code) else times
        code, at = code[begins], at[begins]
        # Groups as text: tokens in the order of groups, the first side before the second.
        shown = np.empty(len(a) + len(b), object)
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[last_a], ends_b[last_b] = 1, 1
        ends_b[np.cumsum(n_b)[n_b > 0] - 1] = 2
        shown[np.arange(len(a)) + (last_b - in_b + 1)[of_a]] = self.a_text[ends_a, a]
        shown[np.arange(len(b)) + (last_a + 1)[of_b]] = self.b_text[ends_b, b]
        texts = [""] * len(new)
        for i, t in zip(np.flatnonzero(n_b).tolist(), "".join(shown).split("\n"), strict=False):
            texts[i] = t
        count = np.bincount(word, minlength=len(new))
        total = np.zeros(len(new), np.int64)
        np.add.at(total, word, n_links)
        return texts, np.stack([n_a, n_b, count, total], axis=1), np.bincount(at, minlength=len(new)), n_a > 0, code, links

    def _add(self, new: list[str]) -> None:
        texts, sums, sizes, whole, codes, links = self._tabled(new)
        self.index.update(zip(new, range(len(self.texts), len(self.texts) + len(new)), strict=True))
        self.texts += texts
        self.sums, self.whole = np.concatenate([self.sums, sums]), np.concatenate([self.whole, whole])
        self.first_code = np.concatenate([self.first_code, self.first_code[-1] + np.cumsum(sizes)])
        self.codes, self.links = np.concatenate([self.codes, codes]), np.concatenate([self.links, links])

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(sums, groups, places, codes, links) of texts: (n_a, n_b, n_groups, n_links) and the groups of each, and the pairs of
        each of its words with the place of the text."""
        names = [self.words(t) for t in texts]
        new = [w for w in dict.fromkeys(chain.from_iterable(names)) if w not in self.index]
        short = [w for w in new if len(w) < CACHED_WORD]
        self._add(short)
        n, n_codes = len(self.texts), len(self.codes)
        long = [w for w in new if len(w) >= CACHED_WORD]
        if long:
            self._add(long)
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        ids = np.fromiter(map(self.index.__getitem__, chain.from_iterable(names)), np.int64, int(sizes.sum()))
        bad = np.r_[0, np.cumsum(~self.whole[ids])]
        ends = np.cumsum(sizes)
        good = bad[ends] == bad[ends - sizes]
        listed, at = ids.tolist(), 0
        groups = []
        for size, fine in zip(sizes.tolist(), good.tolist(), strict=True):
            groups.append(";".join([self.texts[i] for i in listed[at : at + size]]) if fine else "")
            at += size
        ids, sizes = ids[np.repeat(good, sizes)], np.where(good, sizes, 0)
        ends = np.cumsum(sizes)
        running = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.sums[ids], axis=0)])
        n_pairs = self.first_code[ids + 1] - self.first_code[ids]
        which = spans(self.first_code[ids], n_pairs)
        out = running[ends] - running[ends - sizes], groups, np.repeat(np.repeat(np.arange(len(texts)), sizes), n_pairs), self.codes[which], self.links[which]
        for w in long:
            del self.index[w]
        del self.texts[n:]
        self.sums, self.whole, self.first_code, self.codes, self.links = self.sums[:n], self.whole[:n], self.first_code[: n + 1], self.codes[:n_codes], self.links[:n_codes]
        self.held += sum([300 + 4 * len(w) for w in short]) + sum(map(len, self.texts[n - len(short) :])) + 16 * int(self.first_code[-1] - self.first_code[n - len(short)])
        if self.held > CACHE_BYTES:
            self.clear()
        return out


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in 1, 2, 4 or 8 bytes each, the least that holds all."""
    most = int(numbers.max(initial=0))
    return numbers.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


_ENCODED = (
    "chunk bigint, place int, doc_id string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "stripe int, n_codes int, codes binary, counts binary, n_pairs int, docs binary, links binary"
)
_NOTHING = {"place": -1, "doc_id": None, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "stripe": -1, "n_codes": 0, "codes": b"", "counts": b"", "n_pairs": 0, "docs": b"", "links": b""}


def encoded(docs: DataFrame, first: str, second: str, stripes: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of documents (stripe -1) and rows of links (place -1). These have, for a chunk of documents and a stripe, the
    distinct pairs (codes within the stripe) with the number of documents of each, and then pair by pair the places of these
    documents and their links. So counts are summed before any shuffle."""
    columns = [c.split()[0] for c in _ENCODED.split(", ")]
    counted = ("n_a", "n_b", "n_groups", "n_links")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = Pair(first, second, stripes)
        cells = pair.height * pair.width
        chunk, rows, keys, links = TaskContext.get().partitionId() << 32, [], [], []

        def take(names: list, texts: list[str]) -> None:
            sums, groups, places, codes, times = pair.align(texts)
            keys.append(codes << 12 | places + len(rows))
            links.append(times)
            for name, counts, shown in zip(names, sums.tolist(), groups, strict=True):
                rows.append({"doc_id": name, "groups_sha256": hashlib.sha256(shown.encode()).hexdigest() if counts[0] else "", "place": len(rows)} | dict(zip(counted, counts, strict=True)))

        def flush() -> pd.DataFrame:
            nonlocal chunk, rows, keys, links
            key, link, out = np.concatenate(keys), np.concatenate(links), rows
            order = np.argsort(key, kind="stable")
            key = key[order]
            begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            link, key = np.add.reduceat(link[order], begins) if len(key) else link, key[begins]
            places, (stripe, code) = key & CHUNK_DOCS - 1, np.divmod(key >> 12, cells)
            numbers, ends = np.unique(stripe, return_index=True)
            for s, at, end in zip(numbers.tolist(), ends.tolist(), [*ends.tolist()[1:], len(stripe)], strict=True):
                c, n = np.unique(code[at:end], return_counts=True)
                out.append({"stripe": s, "n_codes": len(c), "codes": _narrow(c), "counts": _narrow(n), "n_pairs": end - at, "docs": _narrow(places[at:end]), "links": _narrow(link[at:end])})
            frame = pd.DataFrame([{**_NOTHING, **r, "chunk": chunk} for r in out], columns=columns)
            chunk, rows, keys, links = chunk + 1, [], [], []
            return frame

        for pdf in batches:
            sizes = pdf["text"].str.len().to_numpy()
            # A part of a batch is a run of at most 512 texts and BATCH_CHARS characters, or a longer text alone.
            at = 0
            while at < len(pdf):
                end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 512]), BATCH_CHARS, side="right")))
                take(pdf["id"].iloc[at:end].tolist(), pdf["text"].iloc[at:end].tolist())
                at = end
                if len(rows) > CHUNK_DOCS - 512 or sum(map(len, keys)) >= CHUNK_PAIRS:
                    yield flush()
        if rows:
            yield flush()

    return docs.select(F.col(id).cast("string").alias("id"), text_of(text).alias("text")).mapInPandas(run, _ENCODED)


def counted(links: DataFrame, stripes: int, first_size: int, width: int) -> DataFrame:
    """(stripe, n, codes, counts): the number of documents of every pair, from rows of links of a stripe, dealt by stripe."""
    height = math.ceil(first_size / stripes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, block = None, None

        def cells() -> Iterator[pd.DataFrame]:
            flat = block.reshape(-1)
            found = np.flatnonzero(flat)
            for i in range(0, len(found), CELLS):
                some = found[i : i + CELLS]
                yield pd.DataFrame({"stripe": [at], "n": [len(some)], "codes": [_narrow(some)], "counts": [_narrow(flat[some])]})

        for pdf in batches:
            for stripe, n, codes, counts in zip(pdf["stripe"], pdf["n_codes"], pdf["codes"], pdf["counts"], strict=True):
                if stripe != at:
                    if block is not None:
                        yield from cells()
                    at, block = stripe, np.zeros((height, width), np.int64)
                np.add.at(block, np.divmod(_wide(codes, n), width), _wide(counts, n))
        if block is not None:
            yield from cells()

    dealt = links.select("stripe", "n_codes", "codes", "counts").repartition(partitions_of(links), "stripe").sortWithinPartitions("stripe")
    return dealt.mapInPandas(run, "stripe int, n int, codes binary, counts binary")


def scored(links: DataFrame, counts: DataFrame, stripes: int, first_size: int, width: int) -> DataFrame:
    """(chunk, n, places, best, sums): of the documents of a chunk with links in a stripe, the links that are the best of their
    first id and the sum of the counts of all.

    The counts of a stripe come first in its task and fill the matrix; links stream past. A stripe with more pairs than others is
    several slices, each with the stripe's counts."""
    height, spark = math.ceil(first_size / stripes), links.sparkSession
    sizes = {r["stripe"]: r["n"] for r in links.groupBy("stripe").agg(F.sum("n_pairs").alias("n")).collect()}  # a row for each stripe
    most = max(SLICE_PAIRS, 2 * sum(sizes.values()) // stripes)
    slices = F.broadcast(spark.createDataFrame([(s, math.ceil(n / most)) for s, n in sizes.items()], "stripe int, slices int"))
    none, empty = F.lit(-1).cast("bigint"), F.lit(b"")
    held = counts.join(slices, "stripe").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    held = held.select("stripe", "slice", none.alias("chunk"), "n", "codes", "counts", F.lit(0).alias("n_pairs"), empty.alias("docs"), empty.alias("links"))
    asked = links.join(slices, "stripe").withColumn("slice", F.pmod(F.xxhash64("chunk"), F.col("slices")).cast("int"))
    asked = asked.select("stripe", "slice", "chunk", F.col("n_codes").alias("n"), "codes", "counts", "n_pairs", "docs", "links")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, block, top = None, None, None
        for pdf in batches:
            out = []
            for stripe, slice_, chunk, n, codes, counts, n_pairs, docs, links in pdf.itertuples(index=False, name=None):
                if (stripe, slice_) != at:
                    at, block, top = (stripe, slice_), np.zeros((height, width), np.int64), None
                row, column = np.divmod(_wide(codes, n), width)
                if chunk < 0:
                    block[row, column] = _wide(counts, n)
                    continue
                if top is None:
                    top = block.max(axis=1)
                count = block[row, column]
                times, places, link = _wide(counts, n), _wide(docs, n_pairs), _wide(links, n_pairs)
                found, where = np.unique(places, return_inverse=True)
                best, sums = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
                np.add.at(best, where, link * np.repeat(count == top[row], times))
                np.add.at(sums, where, link * np.repeat(count, times))
                out.append((chunk, len(found), _narrow(found), _narrow(best), _narrow(sums)))
            yield pd.DataFrame(out, columns=["chunk", "n", "places", "best", "sums"])

    both = held.unionByName(asked).repartition(partitions_of(links), "stripe", "slice").sortWithinPartitions("stripe", "slice", "chunk")
    return both.mapInPandas(run, "chunk bigint, n int, places binary, best binary, sums binary")


def summed(parts: DataFrame) -> DataFrame:
    """(chunk, place, n_best, count_sum) from what scored() gives, added up by chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, np.zeros((2, 0), np.int64)

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"chunk": at, "place": np.arange(total.shape[1]), "n_best": total[0], "count_sum": total[1]})

        for pdf in batches:
            for chunk, n, places, best, sums in pdf.itertuples(index=False, name=None):
                if chunk != at:
                    if at is not None:
                        yield rows()
                    at, total = chunk, np.zeros((2, 0), np.int64)
                places = _wide(places, n)
                if n and places[-1] >= total.shape[1]:
                    total = np.pad(total, ((0, 0), (0, int(places[-1]) + 1 - total.shape[1])))
                total[0, places] += _wide(best, n)
                total[1, places] += _wide(sums, n)
        if at is not None:
            yield rows()

    dealt = parts.repartition(partitions_of(parts), "chunk").sortWithinPartitions("chunk")
    return dealt.mapInPandas(run, "chunk bigint, place int, n_best bigint, count_sum bigint")


def align(docs: DataFrame, first: str, second: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each document.

    Tokens are those of a space and the text by the byte-level tokenizer `first`, and of the text by the piece model `second`,
    which adds that space. Null and empty texts, and texts whose tokens don't spell them (with U+2581, or changed by a
    normalizer), have no tokens: zeros and an empty digest; they count nowhere. Texts are encoded whole and may be of any
    length; repeated rows are documents each; null ids stay null; other columns are ignored; an empty table gives no rows."""
    pair = Pair(first, second)
    sizes = len(pair.a_size), pair.width
    stripes = min(sizes[0], max(STRIPES, 2 * partitions_of(docs)))
    table = materialize(encoded(docs, first, second, stripes, id, text))
    links = table.where("stripe >= 0").select("chunk", "stripe", "n_codes", "codes", "counts", "n_pairs", "docs", "links")
    counts = materialize(counted(links, stripes, *sizes))
    sums = summed(scored(links, counts, stripes, *sizes))
    rows = table.where("stripe < 0").select("chunk", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = F.lit(0).cast("bigint")
    return rows.join(sums, ["chunk", "place"], "left").select(
        F.col("doc_id").cast(docs.schema[id].dataType).alias(id), "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
