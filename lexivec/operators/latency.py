"""Latency summaries and rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivec.config import DEFAULT
from lexivec.functions.text import utc_now
from lexivec.operators.evaluate import value_counts

#: Of the percentiles in a summary.
SHARES = (0.5, 0.95, 0.99)


def percentiles(samples: DataFrame, by: str, value: str) -> DataFrame:
    """(by, p): exact percentiles at SHARES, linear between neighbours, looked up at their positions among counted values."""
    counts = value_counts(samples.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("_v")), "_v", [by])
    totals = counts.groupBy(F.col(by).alias("_by")).agg(F.sum("n").alias("_total"))
    placed = counts.join(totals, F.col(by).eqNullSafe(F.col("_by")))

    def at(k):
        return F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("_v")))

    places = [(F.col("_total") - 1) * F.lit(p) for p in SHARES]
    ends = [c for p in places for c in (F.max(p), at(F.floor(p)), at(F.ceil(p)))]
    found = placed.groupBy(by).agg(*[c.alias(f"_{i}") for i, c in enumerate(ends)])

    def between(place, low, high):
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return found.select(by, F.array(*[between(*[F.col(f"_{3 * i + j}") for j in range(3)]) for i in range(len(SHARES))]).alias("p"))


def summary(samples: DataFrame, by: str, value: str, exact: bool = True) -> DataFrame:
    """(by, n, mean, p50, p95, p99, min, max), linear between neighbours, to one digit.

    exact=False takes approximate percentiles."""
    more = [] if exact else [F.percentile_approx(value, list(SHARES), 10_000).alias("p")]
    s = samples.groupBy(by).agg(F.count(value).alias("n"), F.avg(F.col(value).cast("decimal(18,6)")).cast("double").alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), *more)
    if exact:
        s = s.join(percentiles(samples, by, value).withColumnRenamed(by, "_key"), F.col(by).eqNullSafe(F.col("_key")), "left")

    def one(c):
        return F.round(F.coalesce(c, F.lit(0.0)), 1)

    return s.select(by, "n", *[one(F.col("p")[i]).alias(name) for i, name in enumerate(("p50", "p95", "p99"))], *[one(F.col(c)).alias(c) for c in ("mean", "min", "max")])


def rate_limited(requests: DataFrame, client: str, ts: str, order: str, limit: int = DEFAULT.rate_limit) -> DataFrame:
    """requests with allowed: the first `limit` of a client in each minute."""
    minute = F.date_trunc("minute", ts)
    return requests.withColumn("allowed", F.row_number().over(Window.partitionBy(client, minute).orderBy(ts, order)) <= limit)


def write_report(samples: DataFrame, by: str, value: str, folder: str, **facts: str) -> None:
    """Writes the summary as JSON, a row for each stage with `facts` about the run, in place of the report that is there;
    to be called again when more stages are measured."""
    rows = summary(samples, by, value)
    for name, fact in facts.items():
        rows = rows.withColumn(name, F.lit(fact))
    rows.withColumn("written", utc_now()).write.mode("overwrite").option("ignoreNullFields", "false").json(folder)
