import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexivec.llm import graphs, near_dup

WORDS = near_dup.WORDS


def shingles(text):
    w = (text or "").encode().split()
    n = min(WORDS, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(rows):
    """(doc_id, class_id, n_links) of rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    links = defaultdict(set)
    for i, a in sets.items():
        for j, b in sets.items():
            if i != j and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i].add(j)
    out, cls = set(), {}
    for i in sorted(sets):
        if i not in cls:
            todo = [i]
            cls[i] = i
            while todo:
                for j in links[todo.pop()]:
                    if j not in cls:
                        cls[j] = i
                        todo.append(j)
    for i in sets:
        out.add((i, cls[i], len(links[i])))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(n):
        w = [word() for _ in range(rng.randint(3, 120))]
        rows.append(" ".join(w))
        for _ in range(rng.choice([0, 0, 1, 4])):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = word()
            rows.append(rng.choice([" ", "\n", "  "]).join(v))
    return [(i, t) for i, t in enumerate(rows)]


def test_classes_match_brute_force(spark):
    rows = corpus(1, 60) + [(10_000, None), (10_001, ""), (10_002, "one"), (10_003, "one"), (10_004, "x " * 20_000), (10_005, "x " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("set_key", F.lit(1)).withColumn("bands", F.lit(2))
    got = {tuple(r) for r in near_dup.classes(docs).collect()}
    assert got == brute(rows)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_SETS", 4)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(30):
        v = list(base)
        v[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(v)))
    got = {tuple(r) for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_weak_collisions_do_not_chain(spark):
    """Only sets of one bucket meet: a with b and b with c, but not a with c; two that share many bands meet once."""
    alone = iter(range(1000, 10_000))
    rows = []
    for key, own in ((b"a", {0: 1}), (b"b", {0: 1, 1: 2}), (b"c", {1: 2, 2: 3}), (b"d", {2: 3}), (b"x", dict.fromkeys(range(5), 7)), (b"y", dict.fromkeys(range(4), 7)), (b"z", {4: 7})):
        rows.append((key, 1, 1, 10, [own.get(k, next(alone)) for k in range(6)]))
    sets = spark.createDataFrame(rows, "set_key binary, first_id long, copies long, n_grams int, bands array<long>")
    met = defaultdict(set)
    for r in near_dup._meetings(sets, 3).collect():
        for at in r["at"]:
            met[at["band"], at["unit"]].add(bytes(r["set_key"]))
    assert sorted(map(sorted, met.values())) == [[b"a", b"b"], [b"b", b"c"], [b"c", b"d"], [b"x", b"y"], [b"x", b"z"]]


def test_large_clusters_meet_strangers_once(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_SETS", 3)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        v = list(base)
        for _ in range(rng.choice([1, 2, 6, 9, 14])):
            v[rng.randrange(60)] = f"x{rng.random()}"
        rows.append((i, " ".join(v)))
    got = {tuple(r) for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_recall_of_a_query_set(spark, capsys):
    """Links of the documents with ids divisible by 100 to all documents at sf0.1, against exact counts."""
    path = Path("/root/testdata/sf0.1/documents.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    docs = spark.read.parquet(str(path)).select("doc_id", "text")
    shingler = near_dup.Shingler()
    grams = {r["doc_id"]: shingler.grams(r["text"] or "") for r in docs.toLocalIterator()}
    holders = defaultdict(list)
    for i, g in grams.items():
        for x in g.tolist():
            holders[x].append(i)
    true = {}
    for i in (i for i in grams if i % 100 == 0):
        common = defaultdict(int)
        for x in grams[i].tolist():
            for j in holders[x]:
                common[j] += 1
        true[i] = sum(j != i and n >= 0.8 * (len(grams[i]) + len(grams[j]) - n) - 1e-9 for j, n in common.items())
    got = {r["doc_id"]: r["n_links"] for r in near_dup.classes(docs).where("doc_id % 100 = 0").collect()}
    recall = sum(got.values()) / sum(true.values())
    with capsys.disabled():
        print(f"\nop9: {len(true)} queries, {sum(true.values())} links, recall {recall:.4f}")
    assert all(got[i] <= true[i] for i in true) and recall >= 0.99


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text), (1, text + " more"), (1, text + " more"), (None, text), (None, None), (5, ""), (5, ""), (7, "another text of its own kind")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lx_hash", F.lit("mine"))
    out = near_dup.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([(1, text + " more"), (None, None), (5, ""), (5, ""), (7, "another text of its own kind")], key=repr)
    assert near_dup.keep_one(docs.limit(0)).count() == 0 and near_dup.classes(docs.limit(0)).count() == 0


def test_band_plan():
    bands, rows = near_dup.plan_bands(0.8, 0.9995, 256)
    assert bands * rows <= 256 and 1 - (1 - 0.8**rows) ** bands >= 0.9995


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cc", "é", " ", "\n", "\t", "\x1c"]), max_size=40).map("".join))
def test_shingles_are_those_of_words(text):
    got = near_dup.Shingler().grams(text)
    assert len(got) == len(shingles(text)) and (np.diff(got.astype(object)) > 0).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r["node"]: r["root"] for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, **dict.fromkeys(range(200, 250), 200)}
