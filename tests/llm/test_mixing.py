import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexivec.llm import mixing, packing, queries

SCHEMA = "doc_id long, text string, source string"


def table(spark):
    rows = [(i, "w " * (i % 9 + 1), "big") for i in range(400)] + [(1000 + i, "v " * 5, "small") for i in range(40)] + [(2000 + i, "u " * 3, None) for i in range(60)]
    return spark.createDataFrame(rows, SCHEMA)


def tokens(rows):
    out = Counter()
    for r in rows:
        out[r["source"]] += r["n_tokens"]
    return out


def test_repeats_weights_and_blocks(spark):
    sized = mixing.sized(table(spark), "doc_id").cache()
    base, rows = tokens(sized.collect()), mixing.schedule(sized, mixing.Target(max_repeats=3.0), block_tokens=500).collect()
    got = tokens(rows)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in sized.collect()}
    repeats = {s: got[s] / base[s] for s in base}
    assert repeats["big"] == 1 and max(repeats.values()) <= 3.0 and max(repeats.values()) > 2.9
    assert max(Counter((r["doc_id"], r["epoch"]) for r in rows).values()) == 1
    blocks, share = defaultdict(Counter), {s: got[s] / sum(got.values()) for s in got}
    for r in rows:
        blocks[r["block"]][r["source"]] += r["n_tokens"]
    for mix in blocks.values():
        for s in share:
            assert abs(mix[s] / sum(mix.values()) - share[s]) < 0.06
    for b in blocks:
        places = sorted(r["place"] for r in rows if r["block"] == b)
        assert places == list(range(1, len(places) + 1))


def test_exponent_meets_its_target(spark):
    shares = spark.createDataFrame([("a", 0.8), ("b", 0.15), ("c", 0.05)], "source string, share double")
    curve = lambda e: mixing._curve(shares, [e])[e]
    e = mixing.exponent(shares, mixing.Target(max_repeats=2.0))
    assert curve(e)[1] <= 2.0001 and curve(e - 0.001)[1] > 2
    e = mixing.exponent(shares, mixing.Target(max_repeats=None, entropy=0.8))
    assert curve(e)[0] == pytest.approx(0.8, abs=1e-4)


def test_slices_make_the_same_sums(spark, monkeypatch):
    sized = mixing.sized(table(spark), "doc_id")
    key = lambda rows: sorted((r["doc_id"], r["epoch"], r["block"]) for r in rows)
    whole = key(mixing.schedule(sized).collect())
    monkeypatch.setattr(mixing, "SLICE_ROWS", 30)
    assert key(mixing.schedule(sized).collect()) == whole


def brute_schedule(rows, order, target, block_tokens):
    """The uses (row_key, epoch, block) and their order in each block, from the definition and one row at a time."""
    tokens = Counter()
    for r in rows:
        tokens[r["source"]] += r["n_tokens"]
    total = sum(tokens.values())
    share = {s: n / total for s, n in tokens.items() if n}

    def holds(e):
        p, z = share.values(), sum(x**e for x in share.values())
        q = [x**e / z for x in p]
        entropy = -sum(x * math.log(x) for x in q) / math.log(len(q)) if len(q) > 1 else 1.0
        repeats = max(x ** (1 - e) for x in p) / min(x ** (1 - e) for x in p)
        return repeats <= target.max_repeats if target.entropy is None else entropy < target.entropy

    low, high = 0.0, 1.0
    if holds(0.0):
        high = 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if holds(mid) else (mid, high)
    e = round(high, 6)
    most = max(x ** (1 - e) for x in share.values())
    quota = {s: max(tokens[s], math.floor(total * most * x**e + 0.5)) for s, x in share.items()}
    blocks = max(1, math.ceil(sum(quota.values()) / block_tokens))
    uses = []
    for s in tokens:
        mine = [r for r in rows if r["source"] == s]
        at = 0
        for epoch in range(quota[s] // tokens[s] + 1) if s in quota else [0]:
            for r in sorted(mine, key=lambda r: (order["", epoch, r["row_key"]], r["row_key"])):
                if epoch and not r["n_tokens"]:
                    continue
                if s not in quota:
                    uses.append((r["row_key"], epoch, order["", epoch, r["row_key"]] % blocks))
                elif epoch < quota[s] // tokens[s] or at + r["n_tokens"] <= quota[s]:
                    uses.append((r["row_key"], epoch, min(blocks - 1, at * blocks // quota[s])))
                at += r["n_tokens"]
    return e, {(k, ep): (b, 1 + sum((order["block", x, y], y, x) < (order["block", ep, k], k, ep) for y, x, c in uses if c == b)) for k, ep, b in uses}


def orders(spark, sized):
    """The hashes that order rows in an epoch and in a block."""
    epochs = spark.range(12).select(F.col("id").cast("int").alias("epoch"))
    kinds = {"": F.xxhash64(F.lit(0), "epoch", "row_key"), "block": F.xxhash64(F.lit(0), F.lit("block"), "epoch", "row_key")}
    return {(k, r["epoch"], r["row_key"]): r["h"] for k, h in kinds.items() for r in sized.join(epochs).select("epoch", "row_key", F.shiftrightunsigned(h, 1).alias("h")).collect()}


def test_schedule_matches_brute_force(spark):
    rows = [(i, "w " * (i % 9 + 1), "big") for i in range(90)] + [(100 + i, "v " * 5, "small") for i in range(8)] + [(200 + i, "u " * 3, None) for i in range(9)] + [(300, "", "none"), (301, "", "small")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for target in (mixing.Target(max_repeats=3.0), mixing.Target(max_repeats=None, entropy=0.7), mixing.Target(max_repeats=1.0)):
        sized = mixing.sized(docs, "doc_id")
        order = orders(spark, sized)
        exponent, want = brute_schedule(sized.collect(), order, target, 100)
        assert mixing.recipe(sized, target)[1] == pytest.approx(exponent, abs=2e-6)
        assert {(r["row_key"], r["epoch"]): (r["block"], r["place"]) for r in mixing.schedule(sized, target, block_tokens=100).collect()} == want


def test_counts_by_a_tokenizer_or_a_column(spark):
    docs = spark.createDataFrame([(1, "Zwei Wörter, 12345!", "x", 7, {"a": 1}), (2, None, "x", None, {}), (3, "你好世界 再见", "x", 3, None)], "doc_id long, text string, source string, n int, m map<string,int>")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer())
    got = {r["doc_id"]: r["n_tokens"] for r in mixing.sized(docs, "doc_id", tokens=packing.token_count(queries.tokenizer())).collect()}
    assert got == {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in mixing.sized(docs, "doc_id", tokens=F.col("n")).collect()} == {1: 7, 2: 0, 3: 3}
    assert sorted(r["doc_id"] for r in mixing.mix(docs).collect()) == [1, 2, 3]


def test_mix_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", None), (None, "c", "y")], SCHEMA).withColumn("lx_block", F.lit(1))
    out = mixing.mix(docs)
    n = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert out.columns == docs.columns and set(n) == {(1, "a b"), (2, None), (3, ""), (None, "c")} and n[(1, "a b")] == 2
    assert mixing.mix(docs.limit(0)).count() == 0
    once = mixing.mix(docs.where("source = 'x'"))
    assert once.count() == 3
