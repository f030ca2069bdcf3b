"""Meeting of two tables in tasks that hold one side and stream the other: for joins whose pairs must not become rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, FractionalType, IntegralType

#: Rows that ask at one place are cut into slices of so many at least.
SLICE = 256
#: Rows that are asked at once.
BATCH = 2048
#: Bytes of a batch of long rows that goes to Python.
BATCH_BYTES = 4 << 20


class Visitor(Protocol):
    """What a task does at one place: hold() gets all rows that are held there, in parts, before ask() gets any."""

    def hold(self, rows: pd.DataFrame) -> None: ...

    def ask(self, rows: pd.DataFrame) -> pd.DataFrame: ...


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run within it pass rows to Python in batches of about BATCH_BYTES, of which executor and task hold several copies."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def partitions_of(df: DataFrame) -> int:
    """The number of partitions that the session shuffles into."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _filler(kind: DataType) -> Column:
    """A value for the rows of the other side: no null, which pandas would make a float of."""
    if isinstance(kind, ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, (IntegralType, FractionalType)):
        return F.lit(0).cast(kind)
    return F.lit(False) if isinstance(kind, BooleanType) else F.lit(None).cast(kind)


def meet(held: DataFrame, asked: DataFrame, place: str, visitor: Callable[[], Visitor], schema: str) -> DataFrame:
    """The rows that visitors give, of `schema`, with their place before other columns, for the rows of both tables with the same `place`, of which no column is null but
    strings. Other columns of the two tables need different names.

    A task holds what is held at one place and streams what is asked there in parts of BATCH rows, so the held rows of a place
    have to fit in memory, while any number can ask. A place at which many ask is several slices, with a copy of its held rows each."""
    tasks = partitions_of(asked)
    most = max(SLICE, math.ceil(asked.count() / tasks))
    slices = asked.groupBy(place).agg(F.ceil(F.count("*") / most).cast("int").alias("_slices"))
    mine, theirs = [c for c in held.columns if c != place], [c for c in asked.columns if c != place]
    copies = held.join(slices, place).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    dealt = asked.join(slices, place).withColumn("_slice", F.pmod(F.xxhash64(*theirs), F.col("_slices")).cast("int"))
    kinds = {f.name: f.dataType for f in [*held.schema, *asked.schema]}
    both = copies.select(place, "_slice", F.lit(0).alias("_kind"), *mine, *[_filler(kinds[c]).alias(c) for c in theirs]).unionByName(
        dealt.select(place, "_slice", F.lit(1).alias("_kind"), *[_filler(kinds[c]).alias(c) for c in mine], *theirs)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, now = None, None
        for pdf in batches:
            for (where, slice_, kind), part in pdf.groupby([place, "_slice", "_kind"], sort=True, dropna=False):
                if (where, slice_) != at:
                    at, now = (where, slice_), visitor()
                if kind == 0:
                    now.hold(part[mine])
                    continue
                for i in range(0, len(part), BATCH):
                    found = now.ask(part[theirs].iloc[i : i + BATCH])
                    found.insert(0, place, where)
                    yield found

    return both.repartition(tasks, place, "_slice").sortWithinPartitions(place, "_slice", "_kind").mapInPandas(run, schema)
