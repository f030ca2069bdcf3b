import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lexivec.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [
    "a", "The", " ", "  ", "\n", "\t", "'s", "don't", "é", "汉", "字", "\xa0", " ", "1", "23", ".", ",", "<|endoftext|>", "</s>", "<s>", "<unk>", "<0x41>",
    "😀", "\x00", "é", "ﬁ", "​", "　", "\x85", "\x1c", "\r", "x" * 70, "word ", "of ", "of ", " ", " ", "ß", "▁",
]


@pytest.fixture(scope="module")
def both():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=B)
    # The printable characters that stand for bytes: Latin-1 as it is, the rest from U+0100 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    a_bytes = {i: bytes(byte[c] for c in t) for t, i in first.get_vocab(with_added_tokens=False).items()}
    b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(second.id_to_piece, range(second.get_piece_size())))]

    def groups(text):
        """Groups of the whole text, by byte offsets; None without tokens."""
        if not text:
            return None
        data = (" " + text).encode()
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        if b"".join(a_bytes[i] for i in a) != data or b"".join(b_bytes[i] for i in b) != data:
            return None
        ends_a, ends_b = np.cumsum([len(a_bytes[i]) for i in a]).tolist(), np.cumsum([len(b_bytes[i]) for i in b]).tolist()
        ends = sorted({*ends_a} & {*ends_b})
        out = [([], []) for _ in ends]
        for side, ids, at in ((0, a, ends_a), (1, b, ends_b)):
            for i, e in zip(ids, at, strict=True):
                out[next(k for k, end in enumerate(ends) if e <= end)][side].append(i)
        return out

    return groups


def brute(rows, groups):
    found = [(i, groups(t)) for i, t in rows]
    links = [Counter((x, y) for p, q in g or [] for x in p for y in q) for _, g in found]
    count = Counter(p for each in links for p in each)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(n, best.get(x, 0))
    out = []
    for (i, g), each in zip(found, links, strict=True):
        shown = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in g or [])
        out.append((
            i, sum(len(p) for p, _ in g or []), sum(len(q) for _, q in g or []), len(g or []), sum(each.values()),
            sum(n for p, n in each.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in each.items()), hashlib.sha256(shown.encode()).hexdigest() if g else "",
        ))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_matches_brute_force_over_whole_texts(spark, both):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 40)))) for i in range(400)]
    rows += [(7, rows[7][1]), (None, "of the word"), (None, None), (500, ""), (501, " "), (502, "  "), (503, "a "), (504, None), (505, "x" * 500), (506, "of of of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("stripe", F.lit("mine")).withColumn("chunk", F.lit(1))
    assert rows_of(alignment.align(docs, A, B)) == brute(rows, both)


def test_chunks_slices_and_cache_do_not_change_results(spark, both, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_PAIRS", 3)
    monkeypatch.setattr(alignment, "CHUNK_PAIRS", 40)
    monkeypatch.setattr(alignment, "CACHE_BYTES", 2000)
    monkeypatch.setattr(alignment, "CELLS", 2)
    monkeypatch.setattr(alignment, "GROUP_LINKS", 1)
    rng = random.Random(6)
    rows = [(f"id{i}", "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 25)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    assert rows_of(alignment.align(docs, A, B)) == brute(rows, both)
    # One id in every document: its stripe is cut into slices.
    rows = [(f"id{i}", "of the word") for i in range(200)]
    table = alignment.encoded(spark.createDataFrame(rows, "doc_id string, text string").repartition(4), A, B, 64)
    links = table.where("stripe >= 0")
    counts = alignment.counted(links, 64, 50257, 32000)
    sums = alignment.summed(alignment.scored(links, counts, 64, 50257, 32000)).collect()
    assert len(sums) == 200 and {(r["n_best"], r["count_sum"]) for r in sums} == {(3, 600)}


def test_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame([], "doc_id int, text string, n_a string")
    out = alignment.align(docs, A, B)
    assert out.collect() == [] and out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and dict(out.dtypes)["doc_id"] == "int"


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "汉字" * 200_000, "a\n \n" * 200_000])
def test_long_runs(text):
    sums, groups, places, codes, links = alignment.Pair(A, B, 64).align([text, "x"])
    assert sums[0, 0] > 0 and sums[1].tolist()[:3] == [1, 1, 1] and links[places == 0].sum() == sums[0, 3] and groups[0].count("|") == sums[0, 2]


def test_words_stay_few_in_the_cache(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_BYTES", 1 << 20)
    pair, rng = alignment.Pair(A, B, 64), random.Random(1)
    for _ in range(20):
        pair.align(["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(5000)) for _ in range(10)])
        pair.align([" ".join(str(rng.random()) for _ in range(1000))])
        assert all(len(w) < alignment.CACHED_WORD for w in pair.index) and len(pair.index) < 8000 and len(pair.texts) == len(pair.index)
