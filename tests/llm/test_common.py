from pyspark.sql import functions as F

from lexivec.llm import common


def test_sieve(spark):
    df = spark.range(3000).select("id", F.lit(1).alias("lx_bits"))
    keys = spark.range(0, 3000, 7).select(F.xxhash64("id").alias("key"))
    maybe, clear = common.sieve(df, F.xxhash64("id"), keys)
    assert maybe.columns == clear.columns == df.columns
    found, rest = {r["id"] for r in maybe.collect()}, {r["id"] for r in clear.collect()}
    assert found | rest == set(range(3000)) and not found & rest and found >= set(range(0, 3000, 7)) and len(found) < 500
    maybe, clear = common.sieve(df, F.xxhash64("id"), keys.limit(0))
    assert maybe.count() == 0 and clear.count() == 3000


def test_sieve_that_is_full(spark, monkeypatch):
    monkeypatch.setattr(common, "SIEVE_BITS", 8)
    df = spark.range(200)
    maybe, clear = common.sieve(df, F.xxhash64("id"), df.select(F.xxhash64("id").alias("key")))
    assert maybe.count() == 200 and clear.count() == 0
