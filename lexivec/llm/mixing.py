"""Temperature mixing of sources: exponentiated token shares, realised as blocks that each hold the target mix."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivec.llm.common import fresh, text_of, words_of
from lexivec.sources.folders import materialize

MAX_REPEATS = 2.0
BLOCK_TOKENS = 1 << 20
#: Rows of a slice of a source's permutation whose running sum one task makes.
SLICE_ROWS = 20_000
#: The exponent interval is cut into so many parts at once, so often: 32 ** 6 parts.
SECTIONS, ROUNDS = 32, 6


@dataclass(frozen=True)
class Target:
    """A mix in which no source is seen more than max_repeats times while each is seen once in full, or one whose
    entropy is that part of the entropy of equal weights; of both, the exponent that meets both."""

    max_repeats: float | None = MAX_REPEATS
    entropy: float | None = None


def _curve(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """For each exponent: the mix's entropy as a part of the largest one, and the most repeats of a source."""
    p, e = F.col("share"), F.col("e")
    grid = shares.withColumn("e", F.explode(F.array(*[F.lit(float(x)) for x in exponents])))
    sums = grid.groupBy("e").agg(
        F.sum(F.pow(p, e)).alias("z"), F.sum(F.pow(p, e) * F.log(p)).alias("l"), F.max(F.pow(p, 1 - e)).alias("most"), F.min(F.pow(p, 1 - e)).alias("least"), F.count("*").alias("n")
    )
    return {r["e"]: ((math.log(r["z"]) - r["e"] * r["l"] / r["z"]) / math.log(r["n"]) if r["n"] > 1 else 1.0, r["most"] / r["least"]) for r in sums.collect()}


def exponent(shares: DataFrame, target: Target) -> float:
    """The smallest exponent within the repetition limit, or the largest that reaches the entropy, whichever is larger;
    entropy falls and repeats fall as it grows from 0 (equal weights) to 1 (the corpus as it is)."""
    found = 0.0
    for holds in (
        target.max_repeats is not None and (lambda entropy, repeats: repeats <= target.max_repeats),
        target.entropy is not None and (lambda entropy, repeats: entropy < target.entropy),
    ):
        if not holds:
            continue
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
            curve = _curve(shares, grid)
            if not curve:
                break
            first = next((k for k, x in enumerate(grid) if holds(*curve[x])), SECTIONS)
            if first == 0:
                high = low
                break
            low, high = grid[first - 1], grid[first]
        found = max(found, high)
    return round(found, 6)


def recipe(sized: DataFrame, target: Target) -> tuple[DataFrame, float]:
    """(source, tokens, weight, quota) of each source of rows (source, n_tokens), and the exponent.

    The budget is the least for which every source is used once in full."""
    sources = materialize(sized.groupBy("source").agg(F.sum("n_tokens").cast("bigint").alias("tokens")))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = sources.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    e = exponent(shares, target)
    most = shares.agg(F.max(F.pow("share", F.lit(1 - e)))).first()[0] or 1.0
    z = shares.agg(F.sum(F.pow("share", F.lit(e)))).first()[0] or 1.0
    share = F.col("tokens") / F.lit(float(max(total, 1)))
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(e)) / F.lit(z)).otherwise(0.0)
    quota = F.when(F.col("tokens") > 0, F.greatest(F.col("tokens"), F.round(F.lit(float(total) * most) * F.pow(share, F.lit(e))).cast("bigint"))).otherwise(0)
    return sources.select("source", "tokens", weight.alias("weight"), quota.cast("bigint").alias("quota")), e


def schedule(sized: DataFrame, target: Target = Target(), block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """Rows (key columns of sized, source, n_tokens) with epoch, block and place, once for each use in the mix.

    A source is used in whole epochs, each permuted anew, and in a last one as far as its quota goes. A use at the part
    f of its source's quota stands in block floor(f * blocks), so every block holds all sources by weight; in a block
    the order is a permutation again. sized needs the columns row_key, source and n_tokens.
    Null sources are a source of their own; rows without tokens are used in the first epoch only; equal rows are used
    each by itself; an empty table gives an empty schedule."""
    sources, _ = recipe(sized, target)
    sources = materialize(sources)
    totals = sources.agg(F.sum("quota"), F.count("*")).first()
    blocks = max(1, math.ceil((totals[0] or 0) / block_tokens))
    bits = max(0, math.ceil(math.log2(max(1, sized.count() / SLICE_ROWS))))
    per = sources.select(F.col("source").alias("of"), "tokens", "quota", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1).cast("int").alias("full"))

    def order(*more: Column | str) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *more), 1)

    uses = (
        sized.join(per, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("epoch", F.explode(F.when(F.col("n_tokens") > 0, F.sequence(F.lit(0), F.col("full"))).otherwise(F.array(F.lit(0)))))
        .withColumn("h", order("epoch", "row_key"))
        .withColumn("slice", F.shiftright("h", 63 - bits) if bits else F.lit(0).cast("bigint"))
    )
    per_slice = uses.groupBy("source", "epoch", "slice").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy("source", "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slice.select(F.struct("source", "epoch", "slice").alias("k"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "epoch", "slice").orderBy("h", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    summed = uses.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).withColumn("k", F.struct("source", "epoch", "slice"))
    at = summed.join(starts, "k").withColumn("at", F.col("epoch") * F.col("tokens") + F.col("start") + F.col("inner"))
    used = at.where((F.col("epoch") < F.col("full")) | (F.col("at") + F.col("n_tokens") <= F.col("quota")))
    block = F.when(F.col("quota") > 0, F.least(F.floor(F.col("at") / F.col("quota") * blocks), F.lit(blocks - 1))).otherwise(F.pmod("h", F.lit(blocks)))
    out = used.select(*sized.columns, "epoch", block.cast("bigint").alias("block"), order(F.lit("block"), "epoch", "row_key").alias("h"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("h", "row_key", "epoch"))
    return out.withColumn("place", place.cast("bigint")).drop("h")


def _row_key(docs: DataFrame) -> Column:
    """A hash of the whole row. Columns with maps, which have no hash of their own, are hashed as JSON."""
    return F.xxhash64(*[F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema])


def sized(docs: DataFrame, *keys: str, tokens: Column | None = None) -> DataFrame:
    """(keys, row_key, source, n_tokens) of docs (text, source, ...).

    tokens is the number of tokens of a row: a column that docs has, or packing.token_count(path) to have a tokenizer
    count. Without it, runs without white space count, which is only right for languages that have spaces."""
    n = F.size(words_of(text_of())) if tokens is None else F.coalesce(tokens, F.lit(0))
    return docs.select(*keys, _row_key(docs).alias("row_key"), "source", n.cast("bigint").alias("n_tokens"))


def mix(docs: DataFrame, target: Target = Target(), block_tokens: int = BLOCK_TOKENS, seed: int = 0, tokens: Column | None = None) -> DataFrame:
    """docs with each row as often as the mix uses it, at least once.

    Each partition holds a part of every block, block after block and in the order of the mix, so files that are read side
    by side give the blocks. Texts are shuffled once. tokens is as for sized().

    Rows are matched by doc_id and a hash of the whole row; rows that are equal are matched once and used as often as
    all of them together."""
    key, of, row, block, place = (fresh(f"lx_{x}", docs) for x in ("key", "of", "row", "block", "place"))
    rows = materialize(sized(docs, "doc_id", tokens=tokens))
    uses = schedule(rows, target, block_tokens, seed).select(F.col("doc_id").alias(of), F.col("row_key").alias(row), F.col("block").alias(block), F.col("place").alias(place))
    keyed = docs.withColumn(key, _row_key(docs))
    again = rows.groupBy("doc_id", "row_key").count().where("count > 1").select(F.col("doc_id").alias(of), F.col("row_key").alias(row))

    def same(left: DataFrame, right: DataFrame) -> Column:
        return left["doc_id"].eqNullSafe(right[of]) & (left[key] == right[row])

    if not again.isEmpty():
        again = materialize(again)
        single = keyed.join(again, same(keyed, again), "left_anti")
        keyed = single.unionByName(keyed.join(again, same(keyed, again), "left_semi").dropDuplicates(["doc_id", key]))
    out = keyed.join(uses, same(keyed, uses))
    return out.sortWithinPartitions(block, place).select(*docs.columns)
