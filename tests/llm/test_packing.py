import os
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexivec.llm import packing
from lexivec.llm.queries import tokenizer

PATH = tokenizer()


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return packing.WordEncoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aBé'sß .,!İ\u0301\u00a0\x1c\n\t\r1你<|endoftext|>ǅ", max_size=40)))
def test_word_cache_equals_tokenizer(plain, encoder, text):
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_sum_of_squares_fills_bins_without_gaps(sizes):
    bins, offsets = packing.sum_of_squares(np.array(sizes, np.int64), 20)
    for b in set(bins.tolist()):
        inside = sorted((o, s) for o, s, x in zip(offsets.tolist(), sizes, bins.tolist(), strict=True) if x == b)
        at = 0
        for o, s in inside:
            assert o == at
            at += s
        assert at <= 20


def naive(sizes, capacity):
    """(bin levels in order of opening) of each item, with the whole sum of squares made anew for every choice."""
    levels, out = [], []

    def cost(ls):
        return sum(n * n for level, n in Counter(ls).items() if level < capacity)

    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        choices = [(cost([*levels, sizes[i]]), 0)]
        for level in {x for x in levels if x + sizes[i] <= capacity}:
            at = levels.index(level)
            choices.append((cost([*levels[:at], level + sizes[i], *levels[at + 1 :]]), -level))
        _, level = min(choices)
        if level:
            at = levels.index(-level)
            levels[at] = -level + sizes[i]
        else:
            levels.append(sizes[i])
        out.append(-level)
    return out, sorted(levels)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=60))
def test_sum_of_squares_is_the_least_at_each_step(sizes):
    bins, offsets = packing.sum_of_squares(np.array(sizes, np.int64), 12)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    levels = Counter()
    for b, n in zip(bins.tolist(), sizes, strict=True):
        levels[b] += n
    assert ([int(offsets[i]) for i in order], sorted(levels.values())) == naive(sizes, 12)


def test_rounds_go_on_until_one_group_is_left(spark, monkeypatch):
    """More groups than four rounds would merge, and bins that can never be merged."""
    monkeypatch.setattr(packing, "GROUP_ITEMS", 6)
    for text, most in (("cat " * 9, 1.35), ("cat " * 60, 2)):
        out = packing.pack(spark.createDataFrame([(i, text) for i in range(150)], "doc_id long, text string"), PATH, capacity=100).collect()
        used = Counter()
        for r in out:
            used[r["sequence_id"]] += r["length"]
        assert max(used.values()) <= 100 and len(used) <= most * sum(used.values()) / 100 + 1


def test_pack(spark, plain):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["the", "cat,", "É", "zq9"], rng.integers(0, 60))) for _ in range(300)] + [None, "", "word " * 500]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item", F.lit(1))
    got = packing.pack(docs, PATH, capacity=64, with_ids=True)
    out = got.collect()
    want = []
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes()), ids[s : s + 64]) for k, s in enumerate(range(0, len(ids), 64))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"]) for r in out), key=repr) == sorted(want, key=repr)
    used = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 64
    assert len(used) <= 1.05 * sum(used.values()) / 64 + 2
    built = packing.sequences(got).collect()
    assert sorted(len(r["ids"]) for r in built) == sorted(used.values())
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_groups_are_merged(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 20)
    docs = spark.createDataFrame([(i, "cat " * (i % 37)) for i in range(200)], "doc_id long, text string")
    out = packing.pack(docs, PATH, capacity=100).collect()
    used = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert len(used) <= 1.1 * sum(used.values()) / 100 + 1
    assert os.path.exists(PATH)


def test_the_word_cache_is_bounded_by_bytes(monkeypatch):
    import random

    monkeypatch.setattr(packing, "CACHE_BYTES", 1 << 20)
    rng = random.Random(1)
    path = tokenizer()
    encoder, counter = packing.WordEncoder(path), packing.WordCounter(path)
    for _ in range(30):
        plain = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(3000))  # no spaces: one word
        many = " ".join(f"{rng.getrandbits(60):x}" for _ in range(1000))
        for text in (plain, many, f"{many}\n{plain}"):
            whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole and counter.count(text) == len(whole)
        for cache in (encoder, counter):
            assert cache.held < 2 << 20 and len(cache) * packing.ENTRY_BYTES < 2 << 20 and all(len(w) <= packing.CACHED_WORD for w in cache)
