"""Centroid clustering: Lloyd's rounds over whole-number vectors, with exact sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.vectors import LONG, finite, floors, largest, rows, tight
from lexivec.sources.folders import materialize

CLUSTERS, ROUNDS, WIDTH, SCALE, SEED = 8, 10, 64, 1024, "3"
_RESULT = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The squared distance of each row of x to each centroid; exact, as numbers of any size where longs are too short."""
    if max(largest(x), largest(centroids)) >= 1 << 27:
        x, centroids = x.astype(object), centroids.astype(object)
    out = np.zeros((len(x), len(centroids)), x.dtype)
    for j, c in enumerate(centroids):
        out[:, j] = ((x - c) ** 2).sum(axis=1)
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, its squared distance) of each row; the smaller number of equal ones."""
    d = squared_distances(x, centroids)
    at = np.argmin(d, axis=1) if len(x) else np.zeros(0, np.int64)
    return at, d[np.arange(len(x)), at]


def kept(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(id, v) of the vectors with exactly `width` finite components; v has the floors of `scale` times these as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = floors(np.stack(pdf["v"].to_list()), scale) if len(pdf) else np.zeros((0, width), np.int64)
            yield pd.DataFrame({"id": pdf["id"], "v": pd.Series([r.tobytes() for r in tight(x)], dtype=object)})

    good = vectors.where((F.size(vector) == width) & finite(F.col(vector)))
    out = good.select(F.col(id).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(run, "id string, v binary")
    return out.select(F.col("id").cast(vectors.schema[id].dataType).alias("id"), "v")


def _totals(points: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """{cluster: (vectors, sums of their components)} of the clusters that are not empty: each task adds up what it reads,
    and its sums, one row for each centroid and component, merge in a groupBy."""
    k, width = centroids.shape
    sent = points.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        n, sums = np.zeros(k, np.int64), np.zeros((k, width), object)
        for pdf in batches:
            x = rows(pdf["v"], width)
            at, _ = nearest(x, c)
            if largest(x) >= 1 << 27:
                x = x.astype(object)
            for j in np.unique(at).tolist():
                mine = at == j
                n[j] += int(mine.sum())
                sums[j] += x[mine].sum(axis=0).astype(object)
        j, i = np.divmod(np.arange(k * width), width)
        full = n[j] > 0
        yield pd.DataFrame({"cluster": j[full], "component": i[full], "n": n[j[full]], "total": pd.Series([str(s) for s in sums.ravel()[full]], dtype=object)})

    parts = points.select("v").mapInPandas(run, "cluster int, component int, n bigint, total string")
    merged = parts.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in merged.orderBy("cluster", "component").collect():  # clusters x components rows
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["total"]))
    sent.unpersist()
    return out


def first_centroids(points: DataFrame, k: int = CLUSTERS, width: int = WIDTH, seed: str = SEED) -> np.ndarray:
    """The k vectors whose `seed:id` has the smallest SHA-256; of equal ones, that with the smaller bytes, and null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return rows([bytes(r["v"]) for r in points.orderBy(key.asc_nulls_last(), "v").limit(k).collect()], width)


def lloyd(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, id: str = "vec_id", vector: str = "embedding", width: int = WIDTH, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each vector with exactly `width` finite
    components; null vectors and others have none.

    Vectors become whole numbers, floor(scale * x), and are written once; a round sends out the k centroids, and only sums
    come back, so that the driver holds k * width numbers at any size. A cluster without vectors keeps its centroid. With
    fewer than k vectors each is a first centroid; without any the result is empty. Repeated rows are rows like others, null
    ids stay null, other columns are ignored. Components beyond a long are cut to it, as are distances and their sums;
    all sums before that are exact."""
    spark = vectors.sparkSession
    points = materialize(kept(vectors, id, vector, width, scale))
    centroids = first_centroids(points, k, width, seed)
    out_id = F.col("id").alias(id)
    if not len(centroids):
        return points.select(out_id, *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _RESULT.split(", "))])
    for _ in range(rounds):
        for j, (n, sums) in _totals(points, centroids).items():
            centroids[j] = [s // n for s in sums]
    sent = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, d = nearest(rows(pdf["v"], width), sent.value)
            yield pd.DataFrame({"id": pdf["id"], "cluster": at, "distance": np.minimum(d, LONG).astype(np.int64)})

    named = points.select(F.col("id").cast("string").alias("id"), "v")
    assigned = materialize(named.mapInPandas(run, "id string, cluster int, distance bigint"))
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    table = spark.createDataFrame(
        [(j, min(s, LONG), min(sum(sums.values()), LONG), digest[j]) for j, s in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    out = assigned.join(F.broadcast(table), "cluster")  # k rows
    return out.select(F.col("id").cast(vectors.schema[id].dataType).alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
