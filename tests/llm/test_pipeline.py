import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import test_mixing
import test_near_dup
import test_packing
import test_pii
import test_quality
from pyspark.sql import functions as F

from lexivec.llm import mixing, near_dup, packing, pii, quality, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(tmp_path_factory, spark):
    folder = str(tmp_path_factory.mktemp("sf"))
    good = " ".join(["the", "of", "and", "to", "in"][i % 5] if i % 3 == 0 else f"word{chr(97 + i % 26)}{chr(97 + i * 7 % 26)}{chr(97 + i // 26 % 26)}" for i in range(90))
    other = " ".join(["the", "of", "and", "to", "in"][i % 5] if i % 3 == 0 else f"else{chr(97 + i % 26)}{chr(97 + i * 7 % 26)}{chr(97 + i // 26 % 26)}" for i in range(90))
    rows = [(1, good, "en", "a", 0), (2, good + " more.", "en", "a", 0), (3, other + " mail me@x.org now", "en", "b", 0), (4, "junk", "en", "b", 0), (None, None, None, None, None), (1, good, "en", "a", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        seen.append((name, sorted({r["doc_id"] for r in docs.collect()})))
    assert [ids for _, ids in seen] == [[1, 2, 3], [1, 3], [1, 3], [1, 3]]
    text = {r["doc_id"]: r for r in docs.collect()}[3]
    assert "<EMAIL>" in text["text"] and text["n_chars"] == len(text["text"])
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == {1, 3} and all(0 <= r["offset"] < packing.CAPACITY for r in rows)


def test_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_one_query_for_each_operator():
    names = [q.split("_")[0] for q in queries.QUERIES]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 14))
    assert near_dup.THRESHOLD == 0.8 and F


def judged_good(text):
    """The whole rule table, for texts of ASCII characters."""
    n, chars, symbols, dup_lines, repeated = test_quality.brute(text)
    words = test_quality.WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if test_quality.WORD.search(x)]
    return (
        n >= 50 and 100 * repeated <= 50 * n and 200 * n <= 100 * chars <= 1200 * n and 100 * symbols <= 20 * n
        and 100 * text.count("!") <= 50 * n and 100 * len(re.findall("[A-Z][A-Z]", text)) <= 20 * chars
        and 100 * sum(w.lower() in quality.STOP_WORDS for w in words) >= 6 * n and 100 * dup_lines <= 45 * len(lines)
    )


def masked(text):
    """Base spans by their patterns, and the planted secrets."""
    marks = [(a, b, list(pii.BASE)[k].upper()) for a, k, b in test_pii.brute(text)]
    marks += [(m.start(1), m.end(1), "SECRET") for m in re.finditer(r'token = "([0-9a-f]{40})"', text)]
    out, at = [], 0
    for a, b, kind in sorted(marks):
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join(out) + text[at:]


def planted(rng):
    """Good texts of three sources, some with personal data or near copies, one of many tokens, and texts that rules reject."""
    def prose(n):
        return [rng.choice("the of and to in".split()) if rng.random() < 0.3 else "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(4, 7))) for _ in range(n)]

    texts = []
    for k in range(70):
        words = prose(rng.randint(60, 200))
        texts.append(" ".join(words))
        if k % 5 == 0:
            texts.append(" ".join([*words[:40], "changed", *words[40:]]))
        if k % 7 == 0:
            texts.append("\n".join(words))
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    data = [lambda: "a.b@example.org", lambda: "10.0.200.7", lambda: "4111 1111 1111 1111", lambda: "+1 (555) 123-4567"]
    texts = [f'{t} {data[k % 4]()} end' if k % 3 == 0 else f'{t} token = "{hexes()}" end' if k % 3 == 1 else t for k, t in enumerate(texts)]
    texts += [" ".join(prose(6000)), "short", "", None, texts[0].upper(), texts[1].replace(" ", "### "), "the same few words " * 40, " ".join(f"w{i}x" for i in range(90))]
    return [(3 * i + 1, t, "en", rng.choice(["big"] * 6 + ["small", None]), len(t or "")) for i, t in enumerate(texts)]


def test_run_matches_brute_force(spark, tmp_path):
    rows = planted(random.Random(11))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    kept = [r for r in rows if judged_good(r[1])]
    assert 60 < len(kept) < len(rows)
    first = {i for i, c, _ in test_near_dup.brute([r[:2] for r in kept]) if i == c}
    assert len(first) < len(kept)
    clean = [(i, masked(t), lang, source, len(masked(t))) for i, t, lang, source, _ in kept if i in first]
    assert {kind for _, t, *_ in clean for kind in re.findall("<([A-Z]+)>", t)} == {"EMAIL", "IP", "CARD", "PHONE", "SECRET"}

    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer())
    ids = {i: plain.encode(t, add_special_tokens=False).ids for i, t, *_ in clean}
    sized = mixing.sized(spark.createDataFrame(clean, SCHEMA), "doc_id")
    doc_of = {r["row_key"]: r["doc_id"] for r in sized.collect()}
    counted = [{"row_key": r["row_key"], "source": r["source"], "n_tokens": len(ids[r["doc_id"]])} for r in sized.collect()]
    _, uses = test_mixing.brute_schedule(counted, test_mixing.orders(spark, sized), mixing.Target(), mixing.BLOCK_TOKENS)
    used = Counter(doc_of[key] for key, _ in uses)
    assert set(used) == first and max(used.values()) > 1

    want = Counter()
    for i, n in used.items():
        whole = [*ids[i], 1]
        for k, s in enumerate(range(0, len(whole), packing.CAPACITY)):
            part = whole[s : s + packing.CAPACITY]
            want[i, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += n
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    levels = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == levels.get(r["sequence_id"], 0)
        levels[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(levels.values()) == test_packing.naive([r["length"] for r in got], packing.CAPACITY)[1]
