import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.llm import block_search, vectors

INF, NAN = float("inf"), float("nan")
ASKS = "vec_id % 100 = 0"


def brute(rows, k=10):
    top = (1 << 63) - 1
    cut = lambda x: max(-top, min(top, x))
    good = [(i, [cut(math.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(good):
        if i is None or i % 100:
            continue
        scores = [(-cut(sum(x * y for x, y in zip(v, w, strict=False))), j is None, j or 0, j) for b, (j, w) in enumerate(good) if a != b]
        out += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(block_search, "BLOCK", 16)
    monkeypatch.setattr(block_search, "BATCH", 3)
    rng = random.Random(2)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.5, 0.0]) for _ in range(5)]) for i in range(700)]
    rows += [(i, [0.5, 0.5, 0.0, 0.0, -1.0]) for i in range(700, 1001)]  # a third are copies
    rows += [(100, [2.0] * 5), (100, [2.0] * 5), (1100, None), (1200, [1.0, None]), (1300, [INF, 1.0]), (1400, [NAN]), (1500, []), (1600, [1.0, 2.0]), (1601, [3.0] * 7), (None, [4.0] * 5), (-100, [0.0, -1.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).withColumn("rank", F.lit("x")).withColumn("Segment", F.lit(1))
    assert result(block_search.top_k(table, F.expr(ASKS))) == brute(rows)
    assert result(block_search.top_k(table, F.expr(ASKS), k=1)) == brute(rows, 1)


def test_one_id_is_most_of_the_table(spark):
    rng = random.Random(3)
    rows = [(100, [float(rng.randrange(3)) for _ in range(3)]) for _ in range(60)] + [(i, [1.0, 1.0, 1.0]) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    got = block_search.top_k(table, F.expr(ASKS))
    assert result(got) == brute(rows) and dict(got.dtypes) == {"query_id": "int", "rank": "int", "vec_id": "int", "score": "bigint"}


def test_few_rows_and_none(spark):
    rows = [(0, [1.0]), (1, [2.0]), (2, [3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(block_search.top_k(table, F.expr(ASKS))) == brute(rows) == [(0, 1, 2, 3 << 20), (0, 2, 1, 2 << 20)]
    for some in (table.limit(0), table.where("vec_id = 0"), table.where("vec_id > 0"), table.withColumn("embedding", F.lit(None).cast("array<double>"))):
        assert block_search.top_k(some, F.expr(ASKS)).collect() == []
    with pytest.raises(ValueError):
        block_search.top_k(table, F.expr(ASKS), k=0)


@pytest.mark.parametrize("size", [1e5, 1e9, 1e300])
def test_scores_are_exact_at_any_size(spark, size):
    rng = random.Random(4)
    rows = [(i * 50, [rng.uniform(-1, 1) * size for _ in range(3)]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert result(block_search.top_k(table, F.expr(ASKS), k=5)) == brute(rows, 5)


def test_bounds_spare_most_blocks_where_documents_of_a_range_are_alike(spark, monkeypatch):
    monkeypatch.setattr(block_search, "BLOCK", 32)
    rng = np.random.default_rng(5)
    topics = rng.normal(size=(40, 24)) * (rng.random((40, 24)) < 0.2)
    rows = [(i, (topics[i // 100] + 0.01 * rng.normal(size=24)).tolist()) for i in range(4000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scored = []
    assert result(block_search.top_k(table, F.expr(ASKS), scored=scored)) == brute(rows)
    pairs = sum(t.agg(F.sum("scored")).first()[0] for t in scored)
    assert pairs < 0.25 * 40 * 4000


def test_products_are_exact():
    rng = random.Random(1)
    for size in (1 << 10, 1 << 25, 1 << 30, 1 << 62):
        a, b = (np.array([[rng.randrange(-size, size) for _ in range(6)] for _ in range(n)]) for n in (4, 5))
        top = (1 << 63) - 1
        want = [[max(-top, min(top, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for q in b] for p in a]
        assert vectors.products(a, b).tolist() == want
        assert vectors.rows([r.tobytes() for r in vectors.tight(a)], 6).tolist() == a.tolist()
