import random
import re

from pyspark.sql import functions as F

from lexivec.operators import spans

DDL = "doc long, start int, end int"


def test_matches_are_those_of_the_pattern(spark):
    texts = ["", None, "a@b.cc and x@y.dd", "none", "a@b.cc", "é\U0001f600 q@r.ss!", "a@b.cca@b.cc"]
    pattern = r"[a-z]@[a-z]\.[a-z]{2}"
    rows = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").select("doc", spans.matches(F.col("text"), pattern).alias("s")).collect()
    # Places are code points.
    assert {r["doc"]: [tuple(s) for s in r["s"]] for r in rows} == {i: [m.span() for m in re.finditer(pattern, t or "")] for i, t in enumerate(texts)}


def test_overlaps_and_scores_match_brute_force(spark):
    rng = random.Random(4)

    def some(n):
        out = []
        for _ in range(n):
            start = rng.randrange(3000)
            out.append((rng.randrange(4), start, start + rng.choice([0, 1, 3, 40, 700])))
        return out

    found, labels = some(250) + [(9, 0, 5000), (None, 1, 2), (5, None, 4)], some(250) + [(9, 250, 260), (9, 255, 257), (None, 1, 2), (3, 1, None)]
    a, b = spark.createDataFrame(found, DDL), spark.createDataFrame(labels, DDL)
    want = sorted((d, s, e, x, y, min(e, y) - max(s, x)) for d, s, e in found for g, x, y in labels if d is not None and d == g and None not in (s, e, x, y) and min(e, y) > max(s, x))
    got = spans.overlaps(a, b, "doc")
    assert sorted(map(tuple, got.collect())) == want and "NestedLoop" not in got._jdf.queryExecution().toString()
    f, g = {x for x in found}, {x for x in labels}
    part = lambda p, q: (min(p[2], q[2]) - max(p[1], q[1])) / (max(p[2], q[2]) - min(p[1], q[1])) if None not in (*p, *q) and p[0] == q[0] and min(p[2], q[2]) > max(p[1], q[1]) else 0
    hits, met = sum(any(part(p, q) >= 0.5 for q in g) for p in f), sum(any(part(p, q) >= 0.5 for p in f) for q in g)
    row = spans.span_scores(a, b, "doc").first()
    assert (row["n_found"], row["n_labelled"], row["hits"], row["met"]) == (len(f), len(g), hits, met) and row["recall"] == met / len(g)
    none = spans.span_scores(a.limit(0), b, "doc").first()
    assert none["precision"] is None and none["recall"] == 0
