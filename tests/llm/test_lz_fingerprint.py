import hashlib

import numpy as np
from pyspark.sql import functions as F

from lexivec.llm import lz_fingerprint as L


def phrases(text):
    data, seen, start = text.encode(), set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            start = end
    return seen | ({data[start:]} if start < len(data) else set())


def sig(text):
    h = L.PhraseHasher()
    return L.signature(np.array([h.hashes(p, np.array([0]), np.array([len(p)]))[0] for p in phrases(text)], np.uint32))


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        a, b, c = sig(t), sig(edited), sig(after)
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), L.show(a), L.show(b), round(L.likeness(a, b), 9), round(L.likeness(a, c), 9)))
    return sorted(out, key=repr)


def test_edited_pairs_match_brute_force(spark):
    words = np.random.default_rng(1).choice(["the ", "cat é", "sat. ", "on\n", "ma"], (120, 90))
    tables = [
        [(i * 7 % 120, "".join(w[: 1 + i % 90])) for i, w in enumerate(words)],
        [(1, "abc"), (1, "abc"), (1, "abd"), (None, None), (None, "x"), (2, ""), (2, None), (3, "z" * 30_000)],
        [(5, "hello world")],
        [],
    ]
    for rows in tables:
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("tail", F.lit(1))
        got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in L.edited_pairs(docs).collect()]
        assert sorted(got, key=repr) == brute(rows)


def test_text_ids_and_a_sample_of_ids(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLED_IDS", 20)
    rows = [(f"id{i % 97:03}é", f"text {i} of some words " * (i % 5)) for i in range(200)] + [(None, "last"), ("", "empty id")]
    order = sorted(sorted(rows, key=lambda r: r[1]), key=lambda r: (r[0] is not None, r[0] or ""), reverse=True)
    want = sorted((i, hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]).encode()).hexdigest()) for k, (i, t) in enumerate(order) if i is not None)
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted((r["doc_id"], r["edited_sha256"]) for r in L.edited_pairs(docs).collect() if r["doc_id"] is not None) == want


def test_likeness_estimates_the_jaccard_similarity_of_phrase_sets():
    rng = np.random.default_rng(7)
    hasher, errors = L.PhraseHasher(), []
    for k in range(60):
        word = lambda: "".join(chr(256 + 40 * k + d) for d in rng.integers(0, 16, 3))  # noqa: B023, E731
        words = [word() for _ in range(1500)]
        other = [w if rng.random() > k / 100 else word() for w in words]
        a, b = " ".join(words), " ".join(other)
        pa, pb = phrases(a), phrases(b)
        got = L.likeness(L.signature(hasher.one(a.encode())), L.signature(hasher.one(b.encode())))
        errors.append(got - len(pa & pb) / len(pa | pb))
    assert np.abs(errors).max() < 5 * 0.5 / np.sqrt(L.SIZE) and abs(np.mean(errors)) < 0.02


def test_fingerprint_and_compare(spark):
    docs = spark.createDataFrame([(1, "to be or not to be " * 20), (2, "to be or not to be " * 20), (3, "qqq zzz xxx"), (4, None), (5, "")], "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"] for r in L.fingerprint(docs).collect()}
    assert prints[1] == prints[2] != prints[3] and prints[4] == prints[5] == ""
    pairs = spark.createDataFrame([(prints[1], prints[2]), (prints[1], prints[3]), (prints[4], prints[5]), (prints[1], "")], "a string, b string")
    same, other, none, half = [r[0] for r in pairs.select(L.compare("a", "b")).collect()]
    assert same == none == 1.0 and other < 0.2 and half == 0.0
