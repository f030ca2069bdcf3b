"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.sources.folders import materialize

#: ASCII white space, the separators of words throughout this subpackage.
SPACES = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where the optimizer moves or repeats the expression."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The runs of characters that are not ASCII white space, in order."""
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * len(SPACES[1:])), " "), "")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df does not use in any letter case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


#: Bits of the filter that sieve() uses for each key, and the most in all (32 MB), in bitmaps of 32,768 bits.
SIEVE_KEY_BITS, SIEVE_BITS = 8, 1 << 28


def sieve(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key in the only column of keys, rows that surely have none); key and keys are hashes (bigint)
    without nulls, of which repeated ones count once.

    The sieve is a bitmap that grows with the number of keys, up to a size that can be broadcast; the more keys there are
    beyond that, the more rows have to be looked up exactly. It saves the shuffle of the other rows."""
    bits, bitmap, number = (fresh(f"lx_{x}", df) for x in ("bits", "bitmap", "number"))
    size = min(SIEVE_BITS, max(1 << 15, 1 << (SIEVE_KEY_BITS * keys.count()).bit_length()))
    place = F.pmod(F.col(keys.columns[0]), F.lit(size))
    bitmaps = keys.groupBy(F.bitmap_bucket_number(place).alias(number)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(bitmap))
    held = materialize(bitmaps)
    here = df.withColumn(bits, F.pmod(key, F.lit(size)))
    joined = here.join(F.broadcast(held), F.bitmap_bucket_number(F.col(bits)) == F.col(number), "left")
    at = F.bitmap_bit_position(F.col(bits)).cast("int")
    byte = F.conv(F.hex(F.col(bitmap).substr(F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), at % 8 + 1)) != 0, F.lit(False))
    return joined.where(hit).select(*df.columns), joined.where(~hit).select(*df.columns)


#: Keys with more than one in so many of all rows are frequent: there are fewer than that of them.
FREQUENT_SHARE, FREQUENT_LEAST = 1000, 1000


def join_counted(left: DataFrame, right: DataFrame, key: str | list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """left join right on key ("inner" or "left"), where right has one row for each key and in `count` the rows that left
    has of it, in all at most `total`. Null keys meet nothing.

    Frequent keys go with a broadcast, so that no task gets all rows of one: those with more than total / FREQUENT_SHARE
    rows are fewer than FREQUENT_SHARE, however large the tables are. Spark joins the others as it likes."""
    keys = [key] if isinstance(key, str) else key
    limit = max(FREQUENT_LEAST, total // FREQUENT_SHARE)
    frequent = right.where(F.col(count) > limit)
    rest = left.join(F.broadcast(frequent.select(*keys)), keys, "left_anti").join(right.where(F.col(count) <= limit), keys, how)
    return left.join(F.broadcast(frequent), keys).unionByName(rest)


def partitions_of(df: DataFrame) -> int:
    """The number of partitions that the session shuffles into."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running_sums(values: Column) -> Column:
    """For an array of numbers, the sums of what comes before each: [0, v0, v0 + v1, ...], one more than values.

    Works in blocks of the square root of the length, as arrays can only be appended to by copying them."""
    zero = F.array(F.lit(0).cast("bigint"))

    def appended(of: Column, last: Callable[[Column], Column]) -> Column:
        return F.aggregate(of, zero, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + last(x))))

    def cut(n: Column) -> Column:
        width = F.ceil(F.sqrt(n)).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), n, width), lambda s: appended(F.slice(values, s, width), lambda x: x))
        return let(
            blocks,
            lambda b: F.concat(
                F.flatten(F.zip_with(b, F.slice(appended(b, lambda x: F.element_at(x, -1)), F.lit(1), F.size(b)), lambda x, o: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda y: y + o))),
                F.array(F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)),
            ),
        )

    return F.when(F.size(values) == 0, zero).otherwise(cut(F.size(values)))
