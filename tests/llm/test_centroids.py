import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from lexivec.llm import centroids

INF, NAN = float("inf"), float("nan")


def brute(rows, k, rounds, width):
    """Lloyd's rounds in whole numbers of any size."""
    points = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((p for p in points if p[0] is not None), key=lambda p: (hashlib.sha256(f"3:{p[0]}".encode()).hexdigest(), p[1]))
    centers = [list(v) for _, v in (order + [p for p in points if p[0] is None])[:k]]

    def assign():
        out = []
        for _, v in points:
            d = [sum((x - y) ** 2 for x, y in zip(v, c, strict=True)) for c in centers]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = assign()
        for j in range(len(centers)):
            mine = [v for (_, v), (c, _) in zip(points, at, strict=True) if c == j]
            if mine:
                centers[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at, top = assign(), (1 << 63) - 1
    inertia = {}
    for c, d in at:
        inertia[c] = inertia.get(c, 0) + min(d, top)
    return sorted(((i, c, min(d, top), min(inertia[c], top), min(sum(inertia.values()), top), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for (i, _), (c, d) in zip(points, at, strict=True)), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.5, -0.25]) for _ in range(4)]) for i in range(200)]
    rows += [(i, [0.125, 0.5, 0.5, -1.0]) for i in range(200, 300)]  # a third are copies
    rows += [(5, [9.0] * 4), (5, [9.0] * 4), (300, None), (301, []), (302, [1.0] * 3), (303, [1.0] * 5), (304, [1.0, None, 1.0, 1.0]), (305, [INF, 0.0, 0.0, 0.0]), (306, [NAN, 0.0, 0.0, 0.0]), (None, [0.0, 0.0, 0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).withColumn("cluster", F.lit("x")).withColumn("ID", F.lit(1))
    assert result(centroids.lloyd(table, width=4)) == brute(rows, 8, 10, 4)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    got = centroids.lloyd(table, width=2, rounds=3)
    assert result(got) == brute(rows, 8, 3, 2) and dict(got.dtypes)["vec_id"] == "int"
    empty = centroids.lloyd(table.limit(0), width=2)
    assert empty.collect() == [] and empty.columns == got.columns
    assert centroids.lloyd(table, width=3).collect() == []


@pytest.mark.parametrize("size", [1e5, 1e7, 1e15, 1e300])
def test_sums_are_exact_at_any_size(spark, size):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * size for _ in range(2)]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    if size > 1e12:  # components beyond a long are cut to it
        top = ((1 << 63) - 1) / 1024
        got = result(centroids.lloyd(table, k=3, rounds=2, width=2))
        assert len(got) == 40 and max(r[2] for r in got) <= (1 << 63) - 1 and (size < top or min(r[2] for r in got) == 0)
    else:
        assert result(centroids.lloyd(table, k=3, rounds=2, width=2)) == brute(rows, 3, 2, 2)
