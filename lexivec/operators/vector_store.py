"""A stored index of vectors for exact search by inner product: cells around centres, skipped by the bound of their balls."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivec.config import DEFAULT, Config
from lexivec.operators.meet import BATCH, meet
from lexivec.sources.folders import materialize

#: Centres at most, a sample of the vectors, and their bytes: every task gets them. Vectors of a place, about: a part of a
#: cell, the unit that is read or skipped.
CENTRES, CENTRE_BYTES, PLACE = 1024, 32 << 20, 8192
#: Products are rounded to nine digits before they rank, so that a bound has to fall short by more than that.
SLACK = 1e-8


@dataclass(frozen=True)
class VectorIndex:
    """Tables of a dense index.

    centres: (cell, centre), at most CENTRES.
    places: (place, cell, n, radius): parts of cells, no vector of which is farther from the centre than the radius.
    vectors: (place, key, vector), sorted by place in their files."""

    centres: DataFrame
    places: DataFrame
    vectors: DataFrame


def _doubles(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.where("vector is not null").select(key, F.col("vector").cast("array<double>").alias("vector"))


def build_vectors(vectors: DataFrame, folder: str) -> VectorIndex:
    """Writes the index of vectors (key, vector), all of one length, into a folder, in place of what is there, and loads it.

    Null vectors are left out. Centres are the vectors with the smallest hashes of their keys, as many as the square root of the number
    of vectors. A cell with many vectors, such as copies of one, is several places, dealt by hash."""
    spark = vectors.sparkSession
    rows = _doubles(vectors, "key")
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dim")).first()
    many = max(1, min(CENTRES, math.isqrt(facts["n"]), CENTRE_BYTES // (8 * max(1, facts["dim"]))))
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(many).withColumn("cell", (F.row_number().over(Window.orderBy(F.xxhash64("key"), "key")) - 1).cast("int"))
    sample.select("cell", F.col("vector").alias("centre")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
    centres = _matrix(spark.read.parquet(f"{folder}/centres"), facts["dim"])
    sent = spark.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["vector"].to_list())
            half = (sent.value**2).sum(axis=1) / 2
            cell = (x @ sent.value.T - half).argmax(axis=1)
            yield pd.DataFrame({"key": pdf["key"], "vector": list(x), "cell": cell, "distance": np.sqrt(((x - sent.value[cell]) ** 2).sum(axis=1))})

    kind = vectors.schema["key"].dataType.simpleString()
    found = materialize(rows.mapInPandas(nearest, f"key {kind}, vector array<double>, cell int, distance double"))
    parts = found.groupBy("cell").agg(F.ceil(F.count("*") / PLACE).cast("bigint").alias("parts"))  # at most CENTRES rows
    part = F.pmod(F.xxhash64("key", "vector"), F.col("parts"))
    placed = found.join(F.broadcast(parts), "cell").withColumn("place", F.shiftleft(F.col("cell").cast("bigint"), 40) + part)
    placed.repartition("place").sortWithinPartitions("place").select("place", "cell", "key", "vector", "distance").write.mode("overwrite").parquet(f"{folder}/vectors")
    written = spark.read.parquet(f"{folder}/vectors")
    written.groupBy("place", "cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).write.mode("overwrite").parquet(f"{folder}/places")
    return load_vectors(spark, folder)


def load_vectors(spark: SparkSession, folder: str) -> VectorIndex:
    """The index that build_vectors wrote; a folder without one, or with one that was not finished, is an error."""
    centres, places, vectors = (spark.read.parquet(f"{folder}/{name}") for name in ("centres", "places", "vectors"))
    return VectorIndex(centres, places, vectors.select("place", "key", "vector"))


def _matrix(centres: DataFrame, dim: int) -> np.ndarray:
    rows = sorted((r["cell"], r["centre"]) for r in centres.collect())
    return np.array([v for _, v in rows], float).reshape(len(rows), dim)


class Scan:
    """Scores the vectors of one place for questions, and keeps the n best of each and what ties with the last of them."""

    def __init__(self, n: int):
        self.n, self.keys, self.parts = n, [], []

    def hold(self, rows: pd.DataFrame) -> None:
        self.keys += rows["key"].tolist()
        self.parts.append(np.stack(rows["vector"].to_list()))

    def ask(self, rows: pd.DataFrame) -> pd.DataFrame:
        q = np.stack(rows["question"].to_list())
        self.parts = [np.concatenate(self.parts)] if len(self.parts) > 1 else self.parts
        products = np.round(q @ self.parts[0].T, 9)
        m = min(self.n, products.shape[1])
        least = np.maximum(np.partition(products, products.shape[1] - m, axis=1)[:, products.shape[1] - m], rows["low"].to_numpy())
        i, j = np.nonzero(products >= least[:, None])
        qid = rows["qid"].to_numpy()[i]
        return pd.DataFrame({"qid": qid, "key": pd.Series([self.keys[x] for x in j], dtype=object), "score": products[i, j]})


def _routed(asking: DataFrame, index: VectorIndex, n: int, first: bool) -> DataFrame:
    """Questions with the places that they go to: those of the highest bounds that have n vectors together, or the others
    whose bound reaches low. A bound is the product with the centre and the question's length times the radius.

    Tasks get the centres and, for each place, its number, cell, size and radius: 32 bytes for PLACE vectors."""
    spark = asking.sparkSession
    places = sorted((r["place"], r["cell"], r["n"], r["radius"]) for r in index.places.collect())
    dim = index.centres.select(F.coalesce(F.max(F.size("centre")), F.lit(0))).first()[0]
    sent = spark.sparkContext.broadcast((_matrix(index.centres, dim), [np.array(c) for c in zip(*places, strict=True)]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, (numbers, cells, sizes, radii) = sent.value
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                pdf = whole.iloc[at : at + BATCH].reset_index(drop=True)
                q = np.stack(pdf["question"].to_list())
                bound = (q @ centres.T)[:, cells] + np.sqrt((q**2).sum(axis=1))[:, None] * radii
                order = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                best = np.zeros(bound.shape, bool)
                np.put_along_axis(best, order, before < n, axis=1)
                goes = best if first else ~best & (bound >= pdf["low"].to_numpy()[:, None] - SLACK)
                i, j = np.nonzero(goes)
                yield pdf.iloc[i].reset_index(drop=True).assign(place=numbers[j])

    kind = asking.schema["qid"].dataType.simpleString()
    return materialize(asking.select("qid", "question", "low").mapInPandas(run, f"qid {kind}, question array<double>, low double, place bigint"))


def dense_stored_top(questions: DataFrame, index: VectorIndex, n: int | None = None, config: Config = DEFAULT, report: list[DataFrame] | None = None) -> DataFrame:
    """(qid, key, rank, score) by inner product of questions (qid, vector) with unique qids and the index, n for each question.

    A question first meets the places of the highest bounds, which give it an n-th score, and then all others that can hold a
    better one; questions and vectors meet in the tasks of their places, and the driver sees neither. A null question has no
    list, an empty index none for any. `report` gets the tables of questions and places that met."""
    n = n or config.dense_top_n
    asking = materialize(_doubles(questions, "qid").select("qid", F.col("vector").alias("question"), F.lit(float("-inf")).alias("low")))
    kinds = questions.schema["qid"].dataType.simpleString(), index.vectors.schema["key"].dataType.simpleString()
    schema = f"place bigint, qid {kinds[0]}, key {kinds[1]}, score double"
    if index.places.isEmpty():
        return asking.limit(0).select("qid", F.lit(None).cast(kinds[1]).alias("key"), F.lit(1).alias("rank"), F.lit(0.0).alias("score"))
    near_routes = _routed(asking, index, n, True)
    near = materialize(meet(index.vectors, near_routes, "place", lambda: Scan(n), schema))
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "key")
    nth = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == n).select("qid", F.col("score").alias("nth"))
    known = asking.join(nth, "qid", "left").select("qid", "question", F.coalesce("nth", "low").alias("low"))
    far_routes = _routed(known, index, n, False)
    far = meet(index.vectors, far_routes, "place", lambda: Scan(n), schema)
    if report is not None:
        report += [near_routes, far_routes]
    return near.unionByName(far).select("qid", "key", F.row_number().over(best).alias("rank"), "score").where(F.col("rank") <= n)
