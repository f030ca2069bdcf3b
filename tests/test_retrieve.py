import math
from collections import Counter

import numpy as np
import pytest

from lexivec.config import Config
from lexivec.operators import chunk, contain, ground, index, retrieve, vector_store


def bm25(question, docs, n):
    """(key, score) lists by the published formula, ties by key, unmatched documents at 0."""
    tok = {k: t.lower().split() for k, t in docs}
    avg = sum(map(len, tok.values())) / len(tok)
    df = Counter(w for t in tok.values() for w in set(t))
    idf = {w: math.log(len(tok) - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    scores = {}
    for k, t in tok.items():
        tf = Counter(t)
        scores[k] = round(sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in question.lower().split()), 9)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:n]


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(rng.choice(list("abcdefghij"), rng.integers(1, 12)))) for i in range(40)]
    asked = [(0, "a b a"), (1, "zzz"), (2, "j unknown")]
    vec = rng.normal(size=(40, 8))
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    qv = vec[:3]
    return {
        "docs": docs, "asked": asked, "vec": vec,
        "chunks": spark.createDataFrame(docs, "key long, text string"), "questions": spark.createDataFrame(asked, "qid long, question string"),
        "vectors": spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "key long, vector array<double>"),
        "question_vectors": spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qv)], "qid long, vector array<double>"),
    }


def lists(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append((r["key"], r["score"]))
    return out


def test_bm25_with_padding(tables):
    got = lists(retrieve.bm25_top(tables["questions"], tables["chunks"], 30))
    for qid, q in tables["asked"]:
        assert [k for k, _ in got[qid]] == [k for k, _ in bm25(q, tables["docs"], 30)]
        assert np.allclose([s for _, s in got[qid]], [s for _, s in bm25(q, tables["docs"], 30)])
    assert got[1] == [(k, 0.0) for k in range(30)]


def test_stored_index_in_segments(spark, tmp_path, monkeypatch):
    """Lists are the same whatever terms are read in full, and from an index that is loaded again."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    weights = 1 / np.arange(1, 61)
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 30), p=weights / weights.sum()))) for i in range(300)]
    asked = [(q, " ".join(rng.choice(words, 9))) for q in range(6)]
    questions = spark.createDataFrame(asked, "qid long, question string")
    monkeypatch.setattr(index, "SEGMENT", 32)
    index.build_index(spark.createDataFrame(docs, "key long, text string"), str(tmp_path / "index"))
    stored = index.load_index(spark, str(tmp_path / "index"))
    assert stored.postings.agg({"segment": "approx_count_distinct"}).first()[0] > 4
    for leading in (20, 2, 0):
        monkeypatch.setattr(retrieve, "LEADING_POSTINGS", leading)
        got = lists(retrieve.bm25_top(questions, stored, 5))
        for qid, q in asked:
            want = bm25(q, docs, 5)
            assert [k for k, _ in got[qid]] == [k for k, _ in want] and np.allclose([s for _, s in got[qid]], [s for _, s in want])
    every = {(r["qid"], r["key"]): r["score"] for r in retrieve.bm25_scores(questions, stored).collect()}
    assert all(abs(every[q, k] - s) < 1e-8 for q, t in asked for k, s in bm25(t, docs, 300) if s)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        index.load_index(spark, str(tmp_path / "nothing"))


def test_blocks_that_cannot_reach_the_list_are_not_scored(spark, tmp_path):
    """Many texts alike, with a third of them copies of one: lists as by brute force, few pairs scored, ties cut by key."""
    rng = np.random.default_rng(8)
    weights = 1 / np.arange(1, 401)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(400)], rng.integers(5, 60), p=weights / weights.sum())) for _ in range(2000)]
    docs = [(i, texts[i] if i % 3 else texts[0]) for i in range(2000)]
    asked = [(q, " ".join(rng.choice([f"w{i}" for i in range(400)], 12))) for q in range(20)] + [(20, texts[0]), (21, "w0 w1 w2")]
    questions, report = spark.createDataFrame(asked, "qid long, question string"), []
    stored = index.build_index(spark.createDataFrame(docs, "key long, text string").repartition(3), str(tmp_path / "index"))
    got = lists(retrieve.bm25_top(questions, stored, 7, report=report))
    for qid, q in asked:
        want = bm25(q, docs, 7)
        assert [k for k, _ in got[qid]] == [k for k, _ in want] and np.allclose([s for _, s in got[qid]], [s for _, s in want])
    scored, written = report[0].selectExpr("sum(scored)", "count(*)").first()
    assert scored < 0.25 * 22 * 2000 and written < 22 * 3 * 3 * 7


def test_blocks_at_the_edge_of_two_parts_are_merged():
    import pandas as pd

    rows = pd.DataFrame({"term": ["w"], "docs": [[0, 3, 5, 17]], "weights": [[1.0, 3.0, 2.0, 1.5]], "blocks": [[0, 0, 1]], "maxima": [[1.0, 3.0, 1.5]]})
    scorer = retrieve.SegmentScorer(2)
    scorer.hold(rows)
    assert [x.tolist() for x in scorer.lists["w"][2:]] == [[0, 1], [3.0, 1.5]]
    docs, units, read, scored = scorer.best(["w", "x"], [2, 1], [1.0, 1.0], None)
    assert docs.tolist() == [3, 5] and (units * index.UNIT).round(9).tolist() == [6.0, 4.0] and (read, scored) == (2, 4)


def test_index_of_texts_or_tokens_in_segments_of_many_postings(spark, tmp_path, monkeypatch):
    """Weights and keys are those of the formula, with texts that are null or empty at any place, whatever ends a segment; a term is one row of a segment, though its
    chunks came in many parts, and its chunks are in the order of their keys."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(90)], rng.integers(0, 12))) for _ in range(2600)]
    docs = [(f"{(i * 7919) % 2600}#{i % 3:04}", None if i % 7 == 0 or i == 1500 else t) for i, t in enumerate(texts)]
    tok = {k: t.split() for k, t in docs if t is not None}
    avg = np.mean([len(t) for t in tok.values()])
    want = {(w, k): tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg)) for k, t in tok.items() for w, tf in Counter(t).items()}
    chunks = spark.createDataFrame(docs, "key string, text string").coalesce(1)
    tokened = index.chunk_tokens(chunks, "key")
    for rows, segment, postings, least in ((chunks, 1 << 16, 1 << 20, 1), (tokened, 1 << 16, 1 << 20, 1), (tokened, 700, 1 << 20, 4), (tokened, 1 << 16, 3000, 3)):
        monkeypatch.setattr(index, "SEGMENT", segment)
        monkeypatch.setattr(index, "POSTINGS", postings)
        stored = index.build_index(rows, str(tmp_path / "index"))
        keys = {(r["segment"], r["doc"]): r["key"] for r in stored.keys.collect()}
        found = stored.postings.collect()
        assert sorted(keys.values()) == sorted(k for k, _ in docs) and (stored.n, stored.avgdl) == (2600, pytest.approx(avg))
        assert len({r["segment"] for r in found}) >= least and len({(r["segment"], r["term"]) for r in found}) == len(found)
        for s in {s for s, _ in keys}:
            mine = [keys[s, d] for d in range(sum(x == s for x, _ in keys))]
            assert mine == sorted(mine)
        got = {(r["term"], keys[r["segment"], d]): w for r in found for d, w in zip(r["docs"], r["weights"], strict=True)}
        assert got.keys() == want.keys() and np.allclose([got[x] for x in want], list(want.values()))
        for r in found:
            blocks = {}
            for d, w in zip(r["docs"], r["weights"], strict=True):
                blocks[d // index.BLOCK] = max(w, blocks.get(d // index.BLOCK, 0))
            assert (r["docs"], r["df"], r["most"]) == (sorted(r["docs"]), len(r["docs"]), max(r["weights"])) and dict(zip(r["blocks"], r["maxima"], strict=True)) == blocks
        df = Counter(w for w, _ in want)
        assert {r["term"]: r["df"] for r in stored.terms.collect()} == df


def test_the_bound_reads_few_postings_of_frequent_terms(spark, tmp_path, monkeypatch):
    """A question's leading terms are left out where they are frequent, so that the bound does not read a part of the corpus for each question; lists are the same."""
    docs = [(i, f"common{i % 3} rare{i % 40} other") for i in range(400)]
    asked = [(0, "common0"), (1, "common1 rare1"), (2, "rare3 rare4")]
    stored, seen, summed = index.build_index(spark.createDataFrame(docs, "key long, text string"), str(tmp_path / "index")), [], retrieve._summed
    monkeypatch.setattr(retrieve, "_summed", lambda terms, sparse: seen.append(terms.groupBy("qid").agg({"df": "sum"}).collect()) or summed(terms, sparse))
    got = lists(retrieve.bm25_top(spark.createDataFrame(asked, "qid long, question string"), stored, 3))
    for qid, q in asked:
        assert [k for k, _ in got[qid]] == [k for k, _ in bm25(q, docs, 3)]
    assert seen and all(r["sum(df)"] <= 3 * retrieve.LEADING_POSTINGS for x in seen for r in x)


def test_stored_vectors(spark, tmp_path, monkeypatch):
    """Lists of the stored index are those of the scan, with hot copies, keys of text and few or many places."""
    rng = np.random.default_rng(9)
    topics = rng.normal(size=(12, 16))
    rows = [(f"k{i:04}", (topics[i % 12] + 0.05 * rng.normal(size=16)).tolist() if i % 3 else [1.0] * 16) for i in range(1500)] + [("none", None)]
    vectors = spark.createDataFrame(rows, "key string, vector array<float>").repartition(4)
    questions = spark.createDataFrame([(q, (topics[q % 12] + 0.05 * rng.normal(size=16)).tolist()) for q in range(30)] + [(99, None)], "qid int, vector array<double>")
    want = lists(retrieve.dense_top(questions, vectors, 5))
    monkeypatch.setattr(vector_store, "PLACE", 100)
    stored, report = vector_store.build_vectors(vectors, str(tmp_path / "vectors")), []
    assert stored.vectors.count() == 1500 and stored.places.count() > 15
    got = vector_store.dense_stored_top(questions, vector_store.load_vectors(spark, str(tmp_path / "vectors")), 5, report=report)
    assert lists(got) == want and len(want) == 30
    visits = sum(r.count() for r in report)
    assert visits < 0.5 * 30 * stored.places.count()
    assert lists(vector_store.dense_stored_top(questions, stored, 2000)) == lists(retrieve.dense_top(questions, vectors, 2000))
    monkeypatch.setattr(retrieve, "QUESTION_BLOCK", 8)
    assert lists(retrieve.dense_top(questions, vectors, 5)) == want
    empty = vector_store.build_vectors(vectors.limit(0), str(tmp_path / "empty"))
    assert vector_store.dense_stored_top(questions, empty, 5).count() == 0 == vector_store.dense_stored_top(questions.limit(0), stored, 5).count()


def test_an_index_is_built_anew_when_its_table_changes(spark, tmp_path):
    from lexivec.plans import retrieval

    sf = str(tmp_path)
    spark.createDataFrame([(1, "alpha beta")], "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    first = retrieval.sparse_index(spark, sf)
    assert first is retrieval.sparse_index(spark, sf) and first.n == 1
    spark.createDataFrame([(1, "alpha"), (2, "beta")], "doc_id long, text string").write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    assert retrieval.sparse_index(spark, sf).n == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        first.terms.sparkSession.read.parquet(first.terms.inputFiles()[0])


def test_dense_in_blocks(tables, monkeypatch):
    monkeypatch.setattr(retrieve, "QUESTION_BLOCK", 1)
    plan = retrieve.dense_top(tables["question_vectors"], tables["vectors"], 3)
    assert "NestedLoop" not in plan._jdf.queryExecution().toString() and plan.count() == 9
    assert retrieve.dense_top(tables["question_vectors"].limit(0), tables["vectors"], 3).count() == 0


def test_chunks_by_another_counter(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta " * 30)], "doc_id long, text string")
    out = chunk.recursive_chunks(docs, Config(chunk_tokens=40), lambda: len).collect()
    assert len(out) > 10 and all(r["token_count"] == len(r["text"]) <= 40 for r in out)


def test_negative_scores_rank_below_padding(spark):
    docs = [(0, "a"), (1, "a"), (2, "a"), (3, "")]
    got = lists(retrieve.bm25_top(spark.createDataFrame([(0, "a")], "qid long, question string"), spark.createDataFrame(docs, "key long, text string"), 4))
    assert [k for k, _ in got[0]] == [3, 0, 1, 2] and got[0][1][1] < 0


def test_matches_of_score_zero_tie_with_chunks_that_do_not_match(spark):
    """Half of all chunks have the term, which so weighs nothing: the list is the first chunks, as it is by SQL."""
    docs = [(i, f"half{i % 2} rare{i % 40}") for i in range(200)]
    asked = [(0, "half0"), (1, "half1 half0"), (2, "half1 rare2")]
    got = lists(retrieve.bm25_top(spark.createDataFrame(asked, "qid long, question string"), spark.createDataFrame(docs, "key long, text string"), 8))
    for qid, q in asked:
        assert [k for k, _ in got[qid]] == [k for k, _ in bm25(q, docs, 8)]


def test_dense(tables):
    got = lists(retrieve.dense_top(tables["question_vectors"], tables["vectors"], 7))
    scores = np.round(tables["vec"][:3] @ tables["vec"].T, 9)
    for q in range(3):
        assert [k for k, _ in got[q]] == np.lexsort((np.arange(40), -scores[q]))[:7].tolist()
    more = retrieve.dense_top(tables["question_vectors"], tables["vectors"], 100)
    assert more.count() == 120


def test_rrf(spark):
    a = spark.createDataFrame([(0, 10, 1, 0.9), (0, 11, 2, 0.8), (0, 12, 3, 0.7)], "qid long, key long, rank int, score double")
    b = spark.createDataFrame([(0, 12, 1, 5.0), (0, 13, 2, 4.0), (0, 10, 3, 1.0)], "qid long, key long, rank int, score double")
    rows = {r["key"]: r for r in retrieve.rrf(a, b).collect()}
    assert rows[10]["fused"] == pytest.approx(1 / 61 + 1 / 63) and rows[13]["dense"] is None and rows[11]["sparse_rank"] is None
    # 10 and 12 tie and so do 11 and 13: dense rank first, then what only the sparse list has.
    assert sorted(rows, key=lambda k: rows[k]["pool_pos"]) == [10, 12, 11, 13]
    swapped = {r["key"]: r["fused"] for r in retrieve.rrf(b, a).collect()}
    assert swapped == {k: r["fused"] for k, r in rows.items()}
    many = {r["key"]: r["fused"] for r in retrieve.fuse_many([a, b], k=0).collect()}
    assert many[10] == pytest.approx(1 + 1 / 3)
    same = retrieve.rrf(a, a.withColumnRenamed("x", "y")).collect()
    assert max(r["fused"] for r in same) == pytest.approx(0.032787, abs=1e-6)


def test_hybrid_has_all_scores_and_order(tables):
    rows = retrieve.hybrid(tables["questions"], tables["chunks"], tables["vectors"], tables["question_vectors"], 5).orderBy("qid", "pos").collect()
    assert len(rows) == 15 and all(r["fused"] is not None and r["rerank"] is not None for r in rows)
    for q in range(3):
        mine = [r for r in rows if r["qid"] == q]
        assert [r["pos"] for r in mine] == [1, 2, 3, 4, 5]
        assert mine == sorted(mine, key=lambda r: (-r["rerank"], r["pool_pos"]))
    with pytest.raises(ValueError):
        retrieve.rerank(tables["vectors"], tables["questions"], tables["chunks"], -1)


def test_containing(spark):
    text = "one two three four five six seven eight nine ten"
    questions = spark.createDataFrame([(0, text), (1, "short"), (2, text + " eleven"), (3, "xx two three four five six yy")], "qid long, question string")
    chunks = spark.createDataFrame([(0, "zero " + text + "!"), (1, "a shorter one"), (2, text.replace("five", "5"))], "key long, text string")
    assert sorted(tuple(r) for r in contain.containing(questions, chunks).collect()) == [(0, 0), (1, 1)]


def test_passages_of_any_length_in_texts_of_any_kind(spark):
    rng = np.random.default_rng(12)
    parts = ["a", "ab", "the ", "cat", " ", "\n", "é", "汉", "\U0001f600", "x.", "The"]
    texts = [(i, "".join(rng.choice(parts, rng.integers(0, 40)))) for i in range(150)] + [(200, ""), (201, None), (202, "the " * 5000 + "end"), (203, "a" * 30)]
    asked = []
    for q in range(120):
        t = texts[q][1]
        at = int(rng.integers(0, max(1, len(t))))
        asked.append((q, t[at : at + int(rng.integers(1, 25))] or "zz"))
    asked += [(300, ""), (301, None), (302, "the the"), (303, "the " * 4999 + "the end"), (304, "not there at all"), (305, "汉"), (306, "a" * 30), (307, "a" * 31), (308, "one two three four five")]
    questions, chunks = spark.createDataFrame(asked, "qid long, question string"), spark.createDataFrame(texts, "key long, text string").repartition(3)
    want = sorted((q, k) for q, p in asked for k, t in texts if p is not None and t is not None and p in t)
    found = contain.containing(questions, chunks)
    assert sorted(map(tuple, found.collect())) == want
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert contain.containing(questions.limit(0), chunks).count() == 0 == contain.containing(questions, chunks.limit(0)).count()


def test_alignment(spark):
    a, b = (spark.createDataFrame([(i,) for i in ids], "key long") for ids in ([1, 2, 2, 3], [2, 3, 4]))
    assert tuple(index.alignment(a, b, "key").first()) == (2, 1, 1, 1)


def test_chunks(spark):
    docs = spark.createDataFrame([("d", " ".join(f"w{i}" for i in range(300))), ("e", "few words"), ("f", None)], "doc_id string, text string")
    rows = chunk.token_windows(docs, 128, 0.12).orderBy("ordinal").collect()
    assert [(r["chunk_id"], r["token_count"]) for r in rows] == [("d#0000", 128), ("d#0001", 128), ("d#0002", 74)]
    text = "\n\n".join(" ".join(f"p{k}w{i}" for i in range(30)) for k in range(10))
    pieces = chunk.split_text(text, 64, 8)
    assert all(len(p.split()) <= 64 for p in pieces) and set(" ".join(pieces).split()) == set(text.split())
    assert chunk.split_text("x" * 10, 512, 61) == ["x" * 10] and chunk.split_text("", 5, 1) == []
    out = chunk.recursive_chunks(docs, Config(chunk_tokens=100)).collect()
    assert {r["doc_id"] for r in out} == {"d"} and [r["ordinal"] for r in out] == list(range(len(out)))
    with pytest.raises(ValueError):
        chunk.recursive_chunks(docs, Config(chunk_strategy="semantic"))
    assert tuple(chunk.chunk_stats(spark.createDataFrame([], "token_count int")).first()) == (0, 0.0, 0, 0)


def test_retriever_objects(tables):
    from lexivec.operators.retrievers import Dense, Ensemble, Sparse

    asked = tables["questions"].join(tables["question_vectors"], "qid")
    dense, sparse = Dense(tables["vectors"]), Sparse(tables["chunks"])
    fused = Ensemble(dense, sparse).search(asked, 4).collect()
    assert len(fused) == 12 and {r["rank"] for r in fused} == {1, 2, 3, 4} and max(r["score"] for r in fused) <= 1 / 61 + 1e-9
    assert sparse.documents(asked, tables["chunks"], 2).count() == 6
    only = Ensemble(dense, sparse, (1.0, 0.0)).search(asked, 3)
    assert {(r["qid"], r["key"]) for r in only.collect()} == {(r["qid"], r["key"]) for r in dense.search(asked, 3).collect()}
