"""Rule-based quality filter: a table of thresholds compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import SPACES, fresh, let, text_of, words_of

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for as with on be are this was by from or an at not have "
    "der die und das den von zu mit ist ein eine im nicht auf dem des sich auch als es "
    "de la le les et en un une du que est dans pour qui il au sur pas par plus "
    "el los las y se del por con para su lo una no"
).split()

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Keeps a document if least <= 100 * numerator / denominator <= most; all in whole numbers, so that no rounding decides."""

    name: str
    numerator: str
    denominator: str
    least: int = 0
    most: int | None = None

    def column(self, features: Column) -> Column:
        top, bottom = 100 * features[self.numerator], features[self.denominator]
        holds = top >= self.least * bottom
        return holds if self.most is None else holds & (top <= self.most * bottom)


#: Failing one of these is failing the base; every later rule only adds reasons.
BASE_RULES = (
    Rule("enough words", "n_words", "one", least=5_000),
    Rule("few repeated three-word windows", "n_repeat_words", "n_words", most=50),
)
RULES = (
    Rule("mean word length", "word_chars", "n_words", least=200, most=1_200),
    Rule("symbols a word", "n_symbols", "n_words", most=20),
    Rule("exclamation marks a word", "n_exclamations", "n_words", most=50),
    Rule("runs of capitals", "n_capital_pairs", "word_chars", most=20),
    Rule("stop words", "n_stop_words", "n_words", least=6),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=45),
)

#: Low bits of a window's key hold its place in the text, the others hold a part of its hash.
_PLACE_BITS = 28


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window which the text has at least twice.

    Windows are sorted by part of their hash to find those that may repeat; only these are compared as text."""
    place = (1 << _PLACE_BITS) - 1

    def same(a: Column, b: Column) -> Column:
        return F.shiftright(a, _PLACE_BITS) == F.shiftright(b, _PLACE_BITS)

    def neighbours(of: Column, equal) -> Column:
        return F.filter(of, lambda x, j: ((j > 0) & equal(x, F.get(of, j - 1))) | ((j < F.size(of) - 1) & equal(x, F.get(of, j + 1))))

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

    keys = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.shiftleft(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), _PLACE_BITS).bitwiseOR(i.cast("bigint")),
        )
    )

    def exact(maybe: Column) -> Column:
        windows = F.sort_array(
            F.transform(maybe, lambda k: let(k.bitwiseAND(F.lit(place)).cast("int"), lambda p: F.struct(F.concat_ws(" ", F.get(words, p), F.get(words, p + 1), F.get(words, p + 2)).alias("w"), p.alias("p"))))
        )
        twice = let(windows, lambda s: neighbours(s, lambda a, b: a["w"] == b["w"]))
        return let(F.sort_array(F.transform(twice, lambda x: x["p"])), covered)

    found = let(keys, lambda k: let(neighbours(k, same), lambda maybe: F.when(F.size(maybe) == 0, F.lit(0).cast("bigint")).otherwise(exact(maybe))))
    return F.when(F.size(words) < 3, F.lit(0).cast("bigint")).otherwise(found)


def features(text: Column) -> Column:
    """A struct of the counts that the rules compare; text must not be null."""

    def without(chars: str) -> Column:
        return F.length(F.translate(text, chars, ""))

    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return let(
        words_of(text),
        lambda w: let(
            lines,
            lambda x: F.struct(
                F.lit(1).cast("bigint").alias("one"),
                F.size(w).cast("bigint").alias("n_words"),
                without(SPACES).cast("bigint").alias("word_chars"),
                (F.length(text) - without(SYMBOLS)).cast("bigint").alias("n_symbols"),
                (F.length(text) - without("!")).cast("bigint").alias("n_exclamations"),
                F.regexp_count(text, F.lit(r"\p{Lu}\p{Lu}")).cast("bigint").alias("n_capital_pairs"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
                F.size(x).cast("bigint").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
            ),
        ),
    )


def verdicts(counts: Column, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> Column:
    """The table as one expression: the counts, base_failed, kept and the names of the rules that failed."""
    failed = F.filter(F.array(*[F.when(~r.column(counts), F.lit(r.name)) for r in (*base, *rules)]), lambda x: x.isNotNull())
    base_failed = ~F.lit(True)
    for r in base:
        base_failed = base_failed | ~r.column(counts)
    return F.struct(counts.alias("counts"), base_failed.alias("base_failed"), (F.size(failed) == 0).alias("kept"), failed.alias("failed"))


def judge(docs: DataFrame, text: str = "text", into: str = "quality", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with one struct column more: counts, base_failed, kept, failed.

    A null or empty text has no words and fails the base. Rows are judged one by one, so repeated rows, null ids and
    empty tables need no care; a column that is called like `into` is replaced."""
    return docs.withColumn(into, let(features(text_of(text)), lambda c: verdicts(c, rules)))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that pass every rule, with the columns of docs."""
    name = fresh("quality", docs)
    return judge(docs, text, name).where(F.col(name)["kept"]).drop(name)
